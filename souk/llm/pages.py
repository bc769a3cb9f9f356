"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of the blocks they hold, less what lies in links. A
page votes for the paths of its best containers; a path is the chain of tags with their classes and
ids, digits generalised, positions left out. Spark sums the votes per host, and every page of the
host is then extracted again from the elements on the winning paths. A page that has no such element,
or next to no text there, is extracted from its own best container. From these elements the text is
widened to the containers around them, up to body: titles, leads and further sections of the article.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and reader
comments are left out by tag, role and the words of class and id, on both ways. Words alone never leave out
an element that holds the page's article.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm import shared as s

NEAR_BEST = 0.5  # containers with this share of the page's best score get a vote; of the host's best votes, paths win
HOST_SHARE = 1 / 16  # of a host's votes, that a path besides the first must have: a host has few winning paths
FEW = 0.1        # paths that hold less than this share of the page's best score give way to its own best container
FEW_OF_ONE = 0.02  # the same, where that container is a single block outside article and main

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noframes", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog",
         "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
         "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
         "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINER = {"article", "body", "center", "div", "main", "section", "td"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
LEFT_OUT = {"head", "nav", "footer", "aside", "dialog", "menu", "button", "select", "option", "svg", "canvas",
            "object", "audio", "video", "map", "applet", "datalist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog",
         "menu", "menubar", "toolbar", "form"}
WORDS = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar",
         "footer", "colophon", "copyright", "sidebar", "aside", "widget", "widgets", "cookie", "cookies",
         "consent", "gdpr", "notice", "notification", "banner", "popup", "modal", "overlay", "ad", "ads", "adv",
         "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promoted", "promotion",
         "newsletter", "subscribe", "subscription", "signup", "login", "search", "form", "share", "sharing",
         "social", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "disqus",
         "respond", "replies", "pagination", "pager", "paging", "toolbar", "skip", "hidden"}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "replies"}
ABSENT = {"has", "with", "no", "without"}                     # what follows is not what the element is
OF_ARTICLE = {"post", "entry", "article", "story"}            # whose header belongs to the text
BLANKS = " \t\r\n\f\v"
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"},
         "th": {"table"}, "p": CONTAINER | {"li", "blockquote", "dd", "th", "form", "figure", "aside", "header",
                                            "footer", "nav"}, "option": {"select"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)""", re.S)
# The rest of a tag. A quote opens only after an equals sign, ends at the next one however far, and is else a character.
_REST = re.compile(r"""((?>[^>"'=]+|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?|["'])*+)>""")
_NAMED = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_KEYS = {"class", "id", "role", "hidden", "aria-hidden"}
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[a-z]+")
HOST = r"^(?:[a-zA-Z][A-Za-z0-9_+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_HOST = re.compile(HOST)


def host_of(url: str | None) -> str:
    found = _HOST.match((url or "").strip(BLANKS))
    return found[1].lower() if found else ""


def _naming(words: list[str]) -> list[str]:
    """Words of a class or id that say what an element is."""
    for i, word in enumerate(words):
        if word in ABSENT:
            words = words[:i]
            break
    return [] if words[-1:] == ["header"] and words[0] in OF_ARTICLE else words


class Page:
    """Elements in page order, and pieces of text with their element and block."""

    def __init__(self, text: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = [""]
        self.label: list[str] = [""]
        self.skip: list[bool] = [False]   # the element, or one around it, is left out
        self.named: list[set[str]] = [set()]  # words of class and id that name what is left out
        self.pieces: list[tuple[int, int, str]] = []
        self.block = 0
        self._read(text)

    def _read(self, text: str) -> None:
        stack, open_tags = [0], Counter()
        at, end = 0, len(text)
        quotes = True
        while at < end:
            found = _TAG.search(text, at)
            attributes, close = "", found.end() if found else end
            if found and found[2] is not None:
                rest = _REST.match(text, close) if quotes else None
                if rest:
                    attributes, close = rest[1], rest.end()
                elif (stop := text.find(">", close)) >= 0:
                    # No tag ends from here on outside quotes; looking again from each tag would take long.
                    quotes = False
                    attributes, close = text[close:stop], stop + 1
                else:
                    found = None
            begin = found.start() if found else end
            if begin > at:
                self.pieces.append((stack[-1], self.block, text[at:begin]))
            if not found:
                break
            at = close
            if found[2] is None:
                if found[0].startswith("<![CDATA["):
                    self.pieces.append((stack[-1], self.block, found[0][9:-3]))
                continue
            name = found[2].lower()
            if name in BLOCK:
                self.block += 1
            elif name == "br":
                self.pieces.append((stack[-1], self.block, " "))
            if found[1]:
                if open_tags[name]:
                    while self.tag[stack[-1]] != name:
                        open_tags[self.tag[stack.pop()]] -= 1
                    open_tags[self.tag[stack.pop()]] -= 1
                continue
            if name in RAW:
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(text, at)
                at = close.end() if close else end
                continue
            if name in VOID:
                continue
            for i in range(len(stack) - 1, 0, -1) if name in CLOSES else ():
                tag = self.tag[stack[i]]
                if tag in CLOSES[name]:
                    for node in stack[i:]:
                        open_tags[self.tag[node]] -= 1
                    del stack[i:]
                    break
                if tag in HOLDS[name]:
                    break
            self._open(stack[-1], name, attributes)
            if not attributes.rstrip().endswith("/") or name in BLOCK:
                stack.append(len(self.tag) - 1)
                open_tags[name] += 1

    def _open(self, parent: int, name: str, attributes: str) -> None:
        label, words, gone = name, [], False
        if "=" in attributes or "hidden" in attributes:
            for key, *values in _NAMED.findall(attributes):
                key = key.lower()
                if key not in _KEYS:
                    continue
                value = entities.unescape("".join(values)).lower()
                if key == "hidden" or (key == "aria-hidden" and value == "true"):
                    gone = True
                elif key == "role":
                    gone |= value.strip() in ROLES
                elif key in ("class", "id"):
                    for part in sorted(value.split()):
                        label += (".", "#")[key == "id"] + _DIGITS.sub("0", part)
                        words += _naming(_WORD.findall(part))
        within = self.tag[parent]
        if name in LEFT_OUT:
            gone = True
        elif name == "header":  # that of the page; an article's own header keeps its headings
            gone = not any(self.tag[n] in ("article", "main") for n in self._up(parent))
        elif within == "" and name == "body":
            gone = False
        judged = name not in ("html", "body", "article", "main") and name not in HEADING
        self.parent.append(parent)
        self.tag.append(name)
        self.label.append(name if name in ("html", "body") else label)  # their classes vary by page
        self.skip.append(gone)
        self.named.append(WORDS.intersection(words) if judged else set())

    def _up(self, node: int):
        while node > 0:
            yield node
            node = self.parent[node]

    def settle(self) -> None:
        """What is left out passes down; forms are left out unless they wrap the page's content."""
        self._judge_names()
        holds = Counter()
        for node in range(len(self.tag) - 1, 0, -1):
            own = holds[node] + (self.tag[node] in ("article", "main", "h1")) * 3 + (self.tag[node] == "p")
            holds[self.parent[node]] += own
        in_header = [False] * len(self.tag)
        for node in range(1, len(self.tag)):
            above = self.parent[node]
            if self.tag[node] == "form" and holds[node] < 3:
                self.skip[node] = True
            self.skip[node] |= self.skip[above]
            in_header[node] = (in_header[above] or self.tag[node] == "header") and self.tag[node] not in HEADING
        self.header = in_header

    def _judge_names(self) -> None:
        """Leave out what class and id name, but nothing that holds the page's article.

        An element holds it if article, main or a first heading and at least half of the text that is neither in
        links nor in comments lie under it. Comments are left out whatever they hold.
        """
        if not any(self.named):
            return
        count = len(self.tag)
        apart, linked = list(self.skip), [False] * count
        for node in range(1, count):
            above = self.parent[node]
            apart[node] |= apart[above] or not COMMENTS.isdisjoint(self.named[node])
            linked[node] = linked[above] or self.tag[node] == "a"
        size, titled = [0] * count, [False] * count
        for node, _, text in self.pieces:
            if not apart[node] and not linked[node]:
                size[node] += len(text.strip())
        for node in range(count - 1, 0, -1):
            titled[node] |= self.tag[node] in ("article", "main", "h1") and not apart[node]
            size[self.parent[node]] += size[node]
            titled[self.parent[node]] |= titled[node]
        for node in range(1, count):
            if self.named[node] and not (titled[node] and not apart[node] and 2 * size[node] >= size[0]):
                self.skip[node] = True

    def paths(self) -> list[int]:
        """Of each element, a hash of the generalised labels of its block-level chain."""
        out = [0] * len(self.tag)
        for node in range(1, len(self.tag)):
            # Pages of a host may leave out html and body, so chains begin below them.
            above = 0 if self.tag[self.parent[node]] in ("html", "body") else out[self.parent[node]]
            out[node] = (xxhash.xxh64_intdigest(f"{above:x}>{self.label[node]}") >> 1
                         if self.tag[node] in BLOCK else above)
        return out

    def scores(self) -> dict[int, float]:
        """Of each container: text of its blocks, less text in links; a container above gets half."""
        linked = [False] * len(self.tag)
        for node in range(1, len(self.tag)):
            linked[node] = linked[self.parent[node]] or self.tag[node] == "a"
        found: dict[int, float] = {}
        for node, _, text in self.pieces:
            if self.skip[node] or self.header[node]:
                continue
            size = len(text.strip()) * (-1 if linked[node] else 1)
            share, steps = 1.0, 0
            for above in self._up(node):
                if self.tag[above] in CONTAINER:
                    found[above] = found.get(above, 0.0) + size * share
                    share, steps = share / 2, steps + 1
                    if steps == 2:
                        break
        return found

    def under(self, roots: set[int]) -> list[bool]:
        """Of each element, whether it is or lies in one of the given."""
        inside = [False] * len(self.tag)
        for node in range(len(self.tag)):
            inside[node] = node in roots or (node > 0 and inside[self.parent[node]])
        return inside

    def sizes(self) -> tuple[list[int], list[int]]:
        """Characters of text under each element: outside links, in links."""
        linked = [False] * len(self.tag)
        for node in range(1, len(self.tag)):
            linked[node] = linked[self.parent[node]] or self.tag[node] == "a"
        free, links = [0] * len(self.tag), [0] * len(self.tag)
        for node, _, text in self.pieces:
            if not self.skip[node] and not self.header[node]:
                (links if linked[node] else free)[node] += len(text.strip())
        for node in range(len(self.tag) - 1, 0, -1):
            free[self.parent[node]] += free[node]
            links[self.parent[node]] += links[node]
        return free, links

    def widen(self, roots: set[int]) -> tuple[set[int], set[int]]:
        """Elements whose text belongs with that of `roots`, and elements of which only their own text does.

        Climbs from the roots as long as the further text is that of the article: blocks that are not
        mostly links, sections, and any container beside a title or within article and main.
        """
        count = len(self.tag)
        free, links = self.sizes()
        children: list[list[int]] = [[] for _ in range(count)]
        holds, titled, article = [False] * count, [False] * count, [False] * count
        for node in range(1, count):
            children[self.parent[node]].append(node)
            article[node] = article[self.parent[node]] or self.tag[node] in ("article", "main")
        for node in range(count - 1, 0, -1):  # a container, a first heading, in the element or under it
            holds[node] |= self.tag[node] in CONTAINER
            titled[node] |= self.tag[node] == "h1" and not self.skip[node] and free[node] > 0
            holds[self.parent[node]] |= holds[node]
            titled[self.parent[node]] |= titled[node]
        chain = set(roots)
        for root in roots:
            self._around(root, chain)
        whole, own, ended = set(roots), set(), set()
        # The innermost elements first: an element comes after those around it.
        for above in sorted(chain - self._below(roots, children), reverse=True):
            if self.tag[above] in ("html", "body") or self.skip[above]:
                break
            inner = [n for n in children[above] if n in chain]
            if not ended.isdisjoint(inner):
                ended.add(above)
                continue
            size = sum(free[n] for n in inner)
            others = [n for n in children[above] if n not in chain and not self.skip[n] and free[n] + links[n]]
            title = {n for n in others if self.tag[n] in HEADING
                     or (titled[n] and n < inner[0] and links[n] < free[n] < size)}
            for node in others:
                if node in title or (free[node] > links[node] and (
                        not holds[node] or article[above] or title or self.tag[node] in ("article", "section"))):
                    whole.add(node)
                elif not article[above]:
                    ended.add(above)
            own.add(above)
        return whole, own

    def _around(self, node: int, known: set[int]) -> None:
        """Add the elements around one, as far as they are not known."""
        for above in self._up(self.parent[node]):
            if above in known:
                break
            known.add(above)

    def _below(self, roots: set[int], children: list[list[int]]) -> set[int]:
        found, todo = set(), list(roots)
        while todo:
            node = todo.pop()
            if node not in found:
                found.add(node)
                todo += children[node]
        return found

    def text(self, roots: set[int], own: set[int] = frozenset()) -> str:
        """Blocks under the given elements, and text right in those of `own`, in page order."""
        inside = self.under(roots)
        blocks: list[list[str]] = []
        last = None
        for node, block, piece in self.pieces:
            if (inside[node] or node in own) and not self.skip[node] and not self.header[node]:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(piece)
        clean = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
        return "\n\n".join(b for b in clean if b)


def read(text: str | None) -> Page:
    page = Page(text or "")
    page.settle()
    return page


def votes(page: Page) -> list[tuple[int, float]]:
    """(path, weight) of the containers near the best score."""
    scores = page.scores()
    best = max(scores.values(), default=0.0)
    if best <= 0:
        return []
    paths = page.paths()
    found: dict[int, float] = {}
    for node, score in scores.items():
        if score >= NEAR_BEST * best:
            found[paths[node]] = max(found.get(paths[node], 0.0), score / best)
    return sorted(found.items())


def main_text(page: Page, winners: int | list[int] | None) -> str:
    """Text of the article around the elements on the winning paths, the first path first.

    If they hold nothing, or little beside the text of the page's own best container, around that; no
    container: all text.
    """
    winners = [winners] if isinstance(winners, int) else winners or []
    scores = page.scores()
    best = max(scores.values(), default=0.0)
    top = min(n for n, x in scores.items() if x == best) if best > 0 else 0
    roots = _on_paths(page, winners, top) if winners else set()
    if roots and not _few(page, roots, top, best) and (found := page.text(*page.widen(roots))):
        return found
    return page.text(*page.widen({top})) if top else page.text({0})


def _on_paths(page: Page, winners: list[int], top: int) -> set[int]:
    """The containers on the paths. None lies in another; those of the first path go first.

    Beside the first path, a container around the page's best one says less than that one.
    """
    paths = page.paths()
    roots: set[int] = set()
    around: set[int] = set()  # elements around the roots
    for rank, winner in enumerate(winners):
        inside = page.under(roots)
        found = {n for n in range(1, len(paths)) if paths[n] == winner and page.tag[n] in CONTAINER
                 and not page.skip[n] and not inside[n] and n not in around}
        if rank:
            found -= set(page._up(page.parent[top]))
        roots |= found
        for node in found:
            page._around(node, around)
    return roots


def _few(page: Page, roots: set[int], top: int, best: float) -> bool:
    """Whether the roots hold so little beside the page's best container that its article is elsewhere."""
    if not top or page.under(roots)[top]:
        return False
    free, _ = page.sizes()
    held = sum(free[n] for n in roots)
    if held >= FEW * best:
        return False
    inside = page.under({top})
    blocks = {block for node, block, text in page.pieces
              if inside[node] and not page.skip[node] and not page.header[node] and text.strip()}
    lone = len(blocks) < 2 and not any(page.tag[n] in ("article", "main") for n in page._up(top))
    return held < (FEW_OF_ONE if lone else FEW) * best


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, paths): the paths with most votes of each host, best first; ties go to the smaller path."""
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths, weights = [], [], []
        for address, text in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            host = host_of(address)
            for path, weight in votes(read(text)):
                hosts.append(host)
                paths.append(path)
                weights.append(round(weight * 1000))
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()),
                                           pa.array(weights, pa.int64())], ["host", "path", "weight"])
    rows = pages.select(F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    summed = (s.map_batches(rows, each, "host string, path long, weight long")
              .groupBy("host", "path").agg(F.sum("weight").alias("votes")))
    summed = s.settle(summed, "votes")
    best = summed.groupBy("host").agg(F.sum("votes").alias("all"),
                                      F.max(F.struct("votes", (-F.col("path")).alias("less"))).alias("best"))
    wins = (F.col("path") == -F.col("best.less")) | ((F.col("votes") >= NEAR_BEST * F.col("best.votes"))
                                                     & (F.col("votes") >= HOST_SHARE * F.col("all")))
    ranked = (summed.join(best, "host").where(wins).groupBy("host")
              .agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path"))).alias("won")))
    return s.settle(ranked.select("host", F.col("won.path").alias("paths")), "host-paths")


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """All rows and columns but `html`, with __text.

    Null and empty html and pages without text give an empty text; null urls share one host.
    """
    winners = host_paths(pages, url, html).select(F.col("host").alias("__host"), F.col("paths").alias("__paths"))
    address = F.coalesce(F.btrim(F.col(f"`{url}`"), F.lit(BLANKS)), F.lit(""))
    host = F.lower(F.regexp_extract(address, HOST, 1))
    named = pages.withColumn("__host", host).join(winners, "__host", "left").drop("__host")
    columns = [c for c in pages.columns if c != html]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(read(text), paths) for text, paths in
                 zip(batch.column(html).to_pylist(), batch.column("__paths").to_pylist())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())],
                                          [*columns, "__text"])
    out = named.select(*(F.col(f"`{c}`") for c in columns), F.col(f"`{html}`"), "__paths")
    return s.map_batches(out, each, s.extended(pages.drop(html), __text="string"))
