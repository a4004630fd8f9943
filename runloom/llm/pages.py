"""Operator 12. Main text of web pages by tree scoring: paragraphs give points to the containers above them, the best one and its siblings are kept."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.base import small_batches, table, text_runs

# Kinds of HTML elements, and the words that pages name their parts with.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_HEAD = frozenset("title meta link style script base noscript template".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
_CONTAINERS = frozenset("html body div section article main td th blockquote center details form".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CELLS = frozenset("td th caption template".split())
_TABLE = frozenset("table thead tbody tfoot tr td th caption template".split())
_GONE_TAGS = frozenset("head nav footer aside script style noscript template iframe button select textarea svg math dialog menu object embed canvas audio video noembed noframes search".split())
_GONE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_GONE_WORDS = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertisements advertising alert banner breadcrumb breadcrumbs byads comment comments consent cookie cookies disqus disclaimer footer gdpr "
    "lightbox login masthead menu modal nav navbar navigation newsletter notice notices notification notifications outbrain overlay pager pagination paywall popover popup promo promos promotion recommended "
    "recommendations related replies respond share sharing sidebar sidebars sidenav signup skip social sponsor sponsored sponsors subscribe subscription taboola toc toolbar tooltip topbar".split()
)
_HEADER_WORDS = frozenset("site page global main top".split())
_ARTICLE_GONE = frozenset("ad ads advert advertisement comment comments promo related reply respond sponsor sponsored".split())
_NEGATED = frozenset("no not has have with without is js show hide".split())
_STATES = frozenset("open closed enabled disabled on off count".split())
_HIDDEN = frozenset(["hidden", "d-none", "visually-hidden", "sr-only", "screen-reader-text"])

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))|[!?/][^>]*+(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_COMMAS = re.compile("[,،，、]")
_ENDED = re.compile(r"[.!?。！？…][\"'»”’)\]]*$")


@lru_cache(maxsize=10_000)
def _unwanted(names: str, article: bool) -> bool:
    """Whether a class or id names a part that isn't the article's own."""
    for name in names.split():
        if name.lower() in _HIDDEN:
            return True
        words = [w.lower() for w in _NAME_WORDS.findall(name)]
        if not words or words[0] in _NEGATED or words[-1] in _STATES:
            continue
        if "with" in words:
            words = words[: words.index("with")]
        if article:
            if words[0] in _ARTICLE_GONE:
                return True
        elif _GONE_WORDS.intersection(words) or words == ["header"] or ("header" in words and _HEADER_WORDS.intersection(words[:1])):
            return True
    return False


class Page:
    """A page's blocks of text in order, in a tree of block elements, without the parts that can't be the article's.

    Ends of elements that are left out follow the usual rules for paragraphs, list items and
    table cells; an end tag without its start is ignored. The work grows with the length of
    the page, however deep its elements stand.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.names, self.main = [-1], ["html"], [""], [0]
        self.below: dict[int, list[int]] = defaultdict(list)
        self.blocks: list[tuple[int, str, int]] = []
        #: Elements now open: tag, node, whether left out (1: unless an article begins in it), whether a link, form.
        self._open: list[tuple[str, int, int, bool, int]] = [("html", 0, 0, False, -1)]
        self._counts: list[dict[str, int]] = [defaultdict(int)]
        self._tables: dict[str, int] = defaultdict(int)
        self._items = {"li": [0], "dd": [0], "row": [0], "cell": [0]}
        #: Of each form: its number of structural elements; forms without are left out.
        self._forms: list[int] = []
        self._form_of: list[int] = [-1]
        self._articles = 0
        self._text: list[str] = []
        self._links = 0
        self._parse(source)
        self._flush()
        self.blocks = [b for b in self.blocks if self._form_of[b[0]] < 0 or self._forms[self._form_of[b[0]]]]

    def _parse(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            lt = source.find("<", at)
            m = _TAG.match(source, lt) if lt >= 0 else None
            if lt < 0:
                self._add(source[at:])
                return
            if m is None:  # a plain "<"
                after = source.find("<", lt + 1)
                after = end if after < 0 else after
                self._add(source[at:after])
                at = after
                continue
            self._add(source[at:lt])
            at = m.end()
            if name := m["name"]:
                name = name.lower()
                if m["end"]:
                    self._end(name)
                elif self._start(name, m["attrs"]) and name in _RAW:
                    close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                    if close is None:
                        return
                    at = close.start()

    def _add(self, text: str) -> None:
        _, _, out, link, _ = self._open[-1]
        if out or not text:
            return
        text = html.unescape(text)
        self._text.append(text)
        if link:
            self._links += sum(map(len, text.split()))

    def _flush(self) -> None:
        """Ends a block of text."""
        if self._text:
            if text := " ".join("".join(self._text).split()):
                self.blocks.append((self._open[-1][1], text, self._links))
            self._text = []
        self._links = 0

    def _pop(self) -> str:
        name = self._open[-1][0]
        if name in _BLOCKS:
            self._flush()
        self._open.pop()
        if name in _TABLE:
            self._tables[name] -= 1
        if name in _CELLS:
            self._counts.pop()
        if name not in _TABLE:
            self._counts[-1][name] -= 1
        if name in ("ul", "ol", "menu", "dir"):
            self._items["li"].pop()
        elif name == "dl":
            self._items["dd"].pop()
        elif name == "table":
            self._items["row"].pop()
            self._items["cell"].pop()
        elif (kind := _kind(name)) is not None:
            self._items[kind][-1] -= 1
        elif name == "article":
            self._articles -= 1
        return name

    def _close(self, kind: str) -> None:
        if self._items[kind][-1] > 0:
            while _kind(self._pop()) != kind:
                pass

    def _start(self, name: str, attrs: str) -> bool:
        """Opens an element; false for those without content."""
        if name == "br":
            self._add(" ")
        elif name in _BLOCKS:
            self._flush()
        if name in _VOID:
            return False
        if self._counts[-1]["head"] and name not in _HEAD and name != "head":
            self._end("head")
        if name == "html" or name == "body" and self._counts[0]["body"]:
            return False
        if name in _BLOCKS and self._counts[-1]["p"] > 0 and name != "template":
            self._end("p")
        if (kind := _kind(name)) is not None:
            self._close(kind)
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if len(attrs) > 3 else {}
        _, up, out, link, form = self._open[-1]
        if name in ("article", "main") and out == 1:
            out = 0
        out = max(out, self._left_out(name, found))
        if name == "form":
            form = len(self._forms)
            self._forms.append(0)
        elif form >= 0 and name in ("article", "main", "h1", "nav", "header", "footer", "aside"):
            self._forms[form] += 1
        if name in _BLOCKS:
            node = len(self.parent)
            self.below[up].append(node)
            self.parent.append(up)
            self.tag.append(name)
            self.names.append(found.get("class", ""))
            self._form_of.append(form)
            self.main.append(2 if name == "article" or found.get("role") == "article" else 1 if name == "main" or found.get("role") == "main" or found.get("itemprop") == "articleBody" else 0)
            up = node
        self._open.append((name, up, out, link or (name == "a" and "href" in found), form))
        if name in _TABLE:
            self._tables[name] += 1
        else:
            self._counts[-1][name] += 1
        if name in _CELLS:
            self._counts.append(defaultdict(int))
        if name in ("ul", "ol", "menu", "dir"):
            self._items["li"].append(0)
        elif name == "dl":
            self._items["dd"].append(0)
        elif name == "table":
            self._items["row"].append(0)
            self._items["cell"].append(0)
        elif kind is not None:
            self._items[kind][-1] += 1
        elif name == "article":
            self._articles += 1
        return True

    def _left_out(self, name: str, found: dict[str, str]) -> int:
        if name in _GONE_TAGS:
            return 2
        if name == "header":
            return 0 if self._articles or self._counts[0]["main"] else 2
        if not found:
            return 0
        if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
            return 2
        if found.get("role", "").lower() in _GONE_ROLES and name not in ("html", "body", "main", "article"):
            return 1
        if name in ("html", "body", "main"):
            return 0
        named = _unwanted(f"{found.get('class', '')} {found.get('id', '')}", name == "article")
        return (2 if name == "article" or re.search(r"comment|sidebar|disqus", f"{found.get('class', '')} {found.get('id', '')}", re.I) else 1) if named else 0

    def _end(self, name: str) -> None:
        if name == "br":
            self._add(" ")
            return
        if name in ("html", "body") or name in _VOID:
            return
        if name in _TABLE:
            known = self._tables[name] > 0
        else:
            known = self._counts[-1][name] > 0
        while known and self._pop() != name:
            pass


def _kind(name: str) -> str | None:
    """Of which elements a new one ends the last one of the same list or table."""
    return {"li": "li", "dt": "dd", "dd": "dd", "tr": "row", "td": "cell", "th": "cell"}.get(name)


def _points(text: str, links: int) -> float:
    """What a paragraph is worth: one, its commas and its hundreds of characters, less its share of link text."""
    chars = sum(map(len, text.split()))
    return (1 + len(_COMMAS.findall(text)) + len(text) / 100) * (1 - min(1.0, links / chars))


def main_text(source: str) -> str:
    """The main text of a page's HTML; see extract()."""
    page = Page(source)
    if not page.blocks:
        return ""
    n = len(page.parent)
    container = [0] * n  # the nearest one, itself included
    for i in range(1, n):
        container[i] = i if page.tag[i] in _CONTAINERS else container[page.parent[i]]
    score, chars = [0.0] * n, [0] * n
    for node, text, links in page.blocks:
        chars[container[node]] += len(text)
        if page.tag[node] not in _HEADINGS:
            score[container[node]] += _points(text, links)
    whole = score[:]
    for i in range(n - 1, 0, -1):
        if container[i] == i:
            above = container[page.parent[i]]
            score[above] += score[i] / 2
            whole[above] += whole[i]
            chars[above] += chars[i]
    worth = score if any(score) else chars
    best = max(range(n), key=lambda i: (worth[i], -i))
    top = best
    for kind in (1, 2):
        i = best
        while i > 0:
            if page.main[i] == kind:
                top = i
            i = page.parent[i]
    keep, lines = {top}, set()
    named = page.main[top] > 0
    at, under = top, {top}
    # the best container's siblings, and those of the containers around it unless the page names its article
    while at > 0:
        above = page.parent[at]
        for i in (j for j in page.below[above] if j not in under):
            if page.tag[i] in _CONTAINERS:
                same = at == top and page.names[i] and page.names[i] == page.names[top] and page.tag[i] == page.tag[top]
                if whole[i] > 0 and (same or whole[i] >= 0.2 * whole[top]):
                    keep.add(i)
            elif at == top and page.tag[i] in ("h1", "p", "pre"):
                lines.add(i)
        if named and at == top or page.main[above]:
            break
        at = above
        under.add(at)
    kept = [False] * n
    for i in range(n):
        kept[i] = i in keep or (i > 0 and kept[page.parent[i]])
    return " ".join(text for node, text, links in page.blocks if kept[node] or (node in lines and (page.tag[node] == "h1" or _sentence(text, links))))


def _sentence(text: str, links: int) -> bool:
    chars = sum(map(len, text.split()))
    return links < 0.25 * chars and (len(text) >= 80 or _ENDED.search(text) is not None)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in text_runs(batches, 0):
        found = [main_text(t.decode("utf-8", "replace")) for t in texts]
        yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(found, pa.string())], names=[*rows.schema.names[1:], "_out"])


def extract(df: DataFrame, *, key: str = "page_id", source: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row for each page: key, keep's columns, text (the page's main text), n_chars (its code points).

    A paragraph is a run of text inside one block element. It is worth one point, one for each
    comma and one for each hundred characters, less its share of link text. Its container gets
    these, the containers above half as many at each step. The best container, or the article
    that holds it where the page names one, is kept, and so are its siblings and those of the
    containers around it that are worth a fifth of it, have its class, or are sentences.
    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts
    and reader comments are told by element, role, class and id, and left out everywhere; a
    form that has a page's structure in it is no form.

    Character references are decoded once, white space within a block becomes one space, and
    blocks are joined in page order by one space. A null, empty or textless page has an empty
    text, and so does one without a part that could be an article. Pages are read whole, each
    row by itself: repeated rows and null keys each have their result, an empty table gives no
    rows, and other columns of df are not looked at.
    """
    rows = small_batches(df).select(F.col(source).alias("_html"), F.col(key).alias("_key"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[1:])
    out = rows.mapInArrow(_extracted, f"{kinds}, _out string")
    return out.select(F.col("_key").alias(key), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_out").alias("text"), F.length("_out").cast("long").alias("n_chars"))


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: What tree scoring must find in pages of the driver's make, which have one <article> with nothing foreign in it.
OP12_SQL = r"""
WITH body AS (
  SELECT page_id, url, coalesce(regexp_extract(html, '(?is)<article[^>]*>(.*?)(</article>|<footer|$)', 1), '') AS x FROM pages
), bare AS (
  SELECT page_id, url, regexp_replace(regexp_replace(x, '(?i)</?(p|h1|br)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM body
), decoded AS (
  SELECT page_id, url, regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g') AS x FROM bare
), out AS (
  SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM decoded
)
SELECT page_id, url, text, length(text) AS n_chars FROM out
"""
