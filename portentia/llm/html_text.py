"""Main text of web pages by composite text density.

A page is read into a small DOM. Every node gets its link-adjusted density, characters per tag scaled down by the share
of link text and links. The node whose children's densities sum highest is the core of the article; the lowest density
on the path from it to the body is the page's threshold, and nodes beside that path that reach it (more sections of
the same article) are kept with the core. Elements that are never article text (menus, page headers and footers, asides,
forms, scripts) are cut before. A class, id or role that says advert, notice, sidebar, comment and the like is evidence
only: such a part stays if it holds an article, main or h1 or most of the page's unlinked text, and inside an article
the names that also mark paragraphs (notice, alert, share and so on) count only where the part is mostly links, or holds
no paragraph, heading or sentence.

Cases: null, empty or text-free html gives an empty text; unclosed and misnested tags are closed by their parents;
comments or scripts that do not end run to the end of the page; pages of any length are read whole; repeated rows are
handled one by one.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-z][^>]*>|<[!?][^>]*>",
    re.I | re.S,
)
HINTED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
SENTENCE = re.compile(r"[.!?…。！？][\"'»”)]*(?:\s|\Z)")
#: Fixed lists of the markup language and of common names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset("head nav footer aside form button select option dialog menu object canvas svg audio video fieldset".split())
NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice"
    " popup modal newsletter subscribe sidebar aside nav navbar navigation menu breadcrumb breadcrumbs pagination pager"
    " footer masthead header comment comments reply replies respond disqus share sharing social related recommended widget"
    " toolbar login signup search complementary contentinfo alert".split()
)
#: Of these, the names that articles also give to their own paragraphs.
MAYBE = frozenset("ad ads banner promo promotion notice alert share sharing social search widget header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main"
    " nav ol p pre section table ul".split()
)
#: A start tag of the first kind ends an open tag of the second, up to the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


class Page:
    """Nodes in page order, as parallel lists; node 0 is the body."""

    def __init__(self, source: str):
        self.tag, self.parent, self.cut = ["body"], [-1], [False]
        self.named: dict[int, bool] = {}  # nodes whose name says that they are not article text: may it be a paragraph's?
        self.parts: list[tuple[int, str]] = []  # text by node, in page order; a block boundary is an empty text
        self._read(source)
        self._count()
        self._cut_named()
        self._measure()

    def _read(self, source: str) -> None:
        stack, at = [0], 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self.parts.append((stack[-1], html.unescape(source[at : m.start()])))
            at = m.end()
            name = (m[3] or "").lower()
            if not name or name in ("html", "body"):
                continue
            block = name not in INLINE
            if m[2]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        del stack[k:]
                        break
                    if not block and self.tag[stack[k]] not in INLINE:
                        break  # a stray inline end tag does not close a block
            else:
                if name in CLOSES_P:
                    self._end(stack, {"p"}, {"table", "td", "th", "button", "div", "article", "section", "li", "blockquote"})
                if name in IMPLIED:
                    self._end(stack, *IMPLIED[name])
                self.tag.append(name)
                self.parent.append(stack[-1])
                self.cut.append(self.cut[stack[-1]] or self._unwanted(name, stack))
                if not self.cut[-1]:
                    self._note(name, m[4], stack)
                if name not in VOID and not m[4].rstrip().endswith("/"):
                    stack.append(len(self.tag) - 1)
            if block:
                self.parts.append((stack[-1], ""))
            elif name == "br":
                self.parts.append((stack[-1], " "))
        if at < len(source):
            self.parts.append((stack[-1], html.unescape(source[at:])))

    def _end(self, stack: list[int], names: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in names:
                del stack[k:]
                return
            if self.tag[stack[k]] in stop:
                return

    def _unwanted(self, name: str, stack: list[int]) -> bool:
        return name in NEVER or (name == "header" and not any(self.tag[n] in ("article", "main") for n in stack))

    def _note(self, name: str, attributes: str, stack: list[int]) -> None:
        """Keep in mind a node of which a whole class, id or role is made of NAMES."""
        inside = any(self.tag[n] in ("article", "main") for n in stack)
        if name in ("article", "main") and not inside and "comment" not in attributes.lower():
            return
        for values in HINTED.findall(attributes):
            for value in "".join(values).split():
                pieces = {w.lower() for w in WORD.findall(value)}
                if pieces and pieces <= NAMES and name not in HEADINGS and not (inside and name == "header"):
                    self.named[len(self.tag) - 1] = inside and pieces <= MAYBE and self.named.get(len(self.tag) - 1, True)

    def _cut_named(self) -> None:
        """Cut the named nodes that hold neither an article, main or h1 nor most of the unlinked text; of those that may
        be paragraphs the ones that hold no paragraph, heading or sentence, or mostly links."""
        if not self.named:
            return
        n = len(self.tag)
        holds = [self.tag[i] == "h1" or (self.tag[i] in ("article", "main") and i not in self.named) for i in range(n)]
        prose = [tag == "p" or tag in HEADINGS for tag in self.tag]
        for node, text in self.parts:
            prose[node] = prose[node] or SENTENCE.search(text) is not None
        for i in range(n - 1, 0, -1):
            if not self.cut[i]:
                holds[self.parent[i]] = holds[self.parent[i]] or holds[i]
                prose[self.parent[i]] = prose[self.parent[i]] or prose[i]
        unlinked = [c - k for c, k in zip(self.chars, self.links)]
        for i in range(1, n):
            if i in self.named and not holds[i] and 2 * unlinked[i] <= unlinked[0]:
                paragraph = self.named[i] and prose[i] and 2 * self.links[i] <= self.chars[i]
                self.cut[i] = self.cut[i] or not paragraph
            self.cut[i] = self.cut[i] or self.cut[self.parent[i]]

    def path(self) -> list[int]:
        """From the core, the node whose children's densities sum highest, to the body."""
        path = [max(range(len(self.tag)), key=lambda i: (self.sums[i], -i))]
        while path[-1]:
            path.append(self.parent[path[-1]])
        return path

    def _count(self) -> None:
        n = len(self.tag)
        self.chars, self.links, self.tags, self.link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        linked = [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.tag[i] == "a"
        for node, text in self.parts:
            if text and not self.cut[node]:
                size = len(" ".join(text.split()))
                self.chars[node] += size
                self.links[node] += size * linked[node]
        for i in range(n - 1, 0, -1):
            if not self.cut[i] and not self.cut[self.parent[i]]:
                p = self.parent[i]
                self.chars[p] += self.chars[i]
                self.links[p] += self.links[i]
                self.tags[p] += self.tags[i] + 1
                self.link_tags[p] += self.link_tags[i] + (self.tag[i] == "a")

    def _measure(self) -> None:
        self._count()
        n = len(self.tag)
        whole = self.links[0] / max(1, self.chars[0])
        self.density, self.sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if not self.cut[i] and self.chars[i]:
                self.density[i] = self._density(i, whole)
                if i:
                    self.sums[self.parent[i]] += self.density[i]

    def _density(self, i: int, whole: float) -> float:
        c, t = self.chars[i], max(1, self.tags[i])
        lc, lt = max(1, self.links[i]), max(1, self.link_tags[i])
        base = math.log(c / max(1, c - self.links[i]) * self.links[i] + whole * c + math.e)
        ratio = max(1.0, c / lc * t / lt)
        return c / t * (math.log(ratio) / math.log(base) if base > 1 else math.log(ratio))

    def text(self) -> str:
        if not self.chars[0]:
            return ""
        path = self.path()
        core = path[0]
        threshold = min(self.density[i] for i in path)
        for kind in ("article", "main"):  # the outermost one around the core holds its title and other sections
            around = [i for i in path if self.tag[i] == kind]
            if around:
                core = around[-1]
                break
        on_path = set()
        i = core
        while i:
            i = self.parent[i]
            on_path.add(i)
        keep = [False] * len(self.tag)
        for i in range(len(self.tag)):
            if self.cut[i]:
                continue
            if i == core or (i and keep[self.parent[i]]):
                keep[i] = True
            elif i and self.parent[i] in on_path and i not in on_path:
                mostly_links = 2 * self.links[i] > self.chars[i]
                keep[i] = self.density[i] >= threshold and not mostly_links
        blocks, now = [], []
        for node, text in self.parts:
            if text:
                # text of an ancestor lies beside the core: it is content only where the core is the body itself
                if keep[node] and not self.cut[node]:
                    now.append(text)
            elif now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        blocks.append(" ".join("".join(now).split()))
        return "\n".join(b for b in blocks if b)


def main_text(source: str | None) -> str:
    """The article of one page."""
    return Page(source or "").text()


def extract(pages: DataFrame, source: str = "html", out: str = "text", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` columns and the main text of every page; one narrow pass, no shuffle."""
    picked = pages.select(*keep, pages[source].cast("string").alias("__html"))
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x) for x in batch.column("__html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), texts], names=[*kept, out])

    fields = [f"`{n}` {t}" for n, t in picked.drop("__html").dtypes]
    return picked.mapInArrow(run, ", ".join([*fields, f"`{out}` string"]))
