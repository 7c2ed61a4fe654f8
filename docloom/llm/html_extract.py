"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its tags, each with its role (a hash chained over tag, class, id and kind of the enclosing
elements), and its texts, each with the role of the element that holds it. Over all pages of a host a token has
an occurrence vector (its count in every page), compared by a sum of hashes of (page, count) pairs that is folded
map-side, so that a host with a third of all pages sends one row per token and task. Tokens with the same vector
form an equivalence class. A class is valid if enough pages of the host support it (a class of several tags needs
less support, as a host may have several page templates) and if it is ordered: its tokens follow each other in the
same order in every page and repetition. Roles are paths, so ordered classes nest.

The classes make the template. A text belongs to it if its class holds a tag that encloses it, i.e. if it stands
there whenever that part of the template does. Such texts are no content where they stand before or after all that
changes; between changing blocks they are (headings that all articles of a host share), unless a menu follows them. What remains are slots, one per block-level tag of the template: slots that consist of links are menus. Of
the other texts, those go that stand in chrome by the markup's own word (nav, footer, forms, adverts, comments…)
or outside the page's article or main element. Tags that the template doesn't know (few pages have them, or the
host is small) belong to the slot of the nearest enclosing tag that it knows.

A class of copies is no template: where a class has more text outside its tags than inside, or where its texts
are nearly all that its pages have as content, the texts stay (see ``_template_texts``); where they outweigh the changing
content, those beside changing text in the same container stay, so near copies keep their common paragraphs.

Cases: null and empty html give an empty text; unclosed and stray tags are tolerated, an open quote ends at the
next '>', an unfinished tag or comment at the end is markup; time is linear in the page, however deep or broken; a
null or odd url forms a host of its own kind ('' as host); repeated rows get equal results; other columns are
ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, small_batches, tidy

#: A class is valid if at least this share of the host's pages, and so many pages, hold it.
SUPPORT, LEAST_PAGES = 0.5, 3
#: A class of so many tags needs this share of the pages only: a template of some pages. It bounds a host's template to
#: 1 / RARE times the tokens of a mean page.
LEAST_TAGS, RARE = 3, 0.001
#: A text must stand on at least so many pages to be template; a slot is a menu beyond this share of link text.
CONSTANT_PAGES, LINK_SHARE = 5, 0.8
#: Template texts with more than so many times the changing text of their pages outweigh it; they may have so many characters a page then.
OUTWEIGHS, COPY_CHARS = 2, 1000
#: Templates are broadcast up to so many tokens in all, beyond that they are joined by a shuffle.
BROADCAST_TOKENS = 2_000_000

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'=]*+)")
_ATTR = re.compile(r"([^\s=\"'>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_RAW = {"script", "style", "template", "iframe", "textarea", "title", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p",
    "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_CHROME_TAGS = {"nav", "footer", "aside", "form", "head", "dialog", "menu", "button", "search"}
_CHROME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "aside", "cookie", "cookies",
    "consent", "notice", "notices", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "social", "share", "sharing", "comment", "comments", "disqus", "replies",
    "respond", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "related", "recommended", "pagination", "pager", "toolbar", "login", "signup", "widget",
}
_CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "menu"}
#: An opening tag closes the nearest of these, unless one of the borders stands in between.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
_SCOPES = {"article", "main", "div", "section", "table", "td", "th", "body", "html", "ul", "ol", "dl", "blockquote", "form", "aside", "nav", "header", "footer"}


class Element(NamedTuple):
    """What an open tag means: role (path hash), name, chrome, region ('', 'main' or 'article'), in a link, role of the parent."""

    role: int
    tag: str
    chrome: bool
    region: str
    link: bool
    up: int


ROOT = Element(0, "", False, "", False, 0)


def _h(*parts) -> int:
    """Hash of 63 bits."""
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) >> 1


def _chrome(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Is the element page chrome by its own name? inside: it stands in an article."""
    if tag in _CHROME_TAGS or tag == "header" and not inside or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in _CHROME_ROLES:
        return True
    words = set(re.split(r"[\s_-]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())) - {""}
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return bool(words & {"comment", "comments", "ad", "ads", "advert", "related", "teaser"})
    return bool(words & _CHROME_WORDS) or "header" in words and not inside


def _element(up: Element, tag: str, source: str) -> Element:
    """The element of a tag in its parent; ``source``: its attributes as they stand."""
    attrs = {a[0].lower(): markup.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(source)} if source else {}
    names = " ".join(sorted(set(attrs.get("class", "").split())))
    own = attrs.get("id", "")
    chrome = up.chrome or _chrome(tag, attrs, up.region == "article")
    region = "article" if tag == "article" or up.region == "article" else "main" if tag == "main" or attrs.get("role") == "main" or up.region == "main" else ""
    role = _h(up.role, tag, names, "" if re.search(r"\d", own) else own, chrome, region)
    return Element(role, tag, chrome, region, up.link or tag == "a", up.role)


class Page:
    """``tags``: elements in page order; ``texts``: (block number, element, text, place among the tags) of every piece of text."""

    _known: dict[tuple[int, str, str], Element] = {}

    def __init__(self, source: str):
        self.tags: list[Element] = []
        self.texts: list[tuple[int, Element, str, int]] = []
        self._block = 0
        self._stack: list[Element] = [ROOT]
        self._open: dict[str, list[int]] = defaultdict(list)  # places of open tags by name
        self._scopes = [0]
        begin = at = 0
        n = len(source)
        while (lt := source.find("<", at)) >= 0:
            m = _TAG.match(source, lt)
            if m:
                end, close, tag, rest = m.end(), m[1], m[2].lower(), m[3]
            elif named := _NAME.match(source, lt):  # an open quote, or an unfinished tag
                if (end := source.find(">", lt) + 1) == 0:
                    break
                close, tag, rest = named[1], named[2].lower(), ""
            elif source.startswith(("<!", "<?", "</"), lt):
                self._text(source[begin:lt])
                if source.startswith("<![CDATA[", lt):
                    end = source.find("]]>", lt)
                    self._text(source[lt + 9 : end if end >= 0 else n], False)
                    begin = at = end + 3 if end >= 0 else n
                elif source.startswith("<!--", lt):
                    begin = at = n if (end := source.find("-->", lt + 2)) < 0 else end + 3
                else:
                    begin = at = source.find(">", lt) + 1 or n
                continue
            else:  # a sign in the text
                at = lt + 1
                continue
            self._text(source[begin:lt])
            begin = at = end
            if close:
                self._end(tag)
                self._block += tag in _BLOCK
                continue
            if tag in _BLOCK:
                self._block += 1
                self._end("p")
            if tag in _CLOSES:
                self._implied(*_CLOSES[tag])
            up = self._stack[-1]
            if tag == "br":
                self.texts.append((self._block, up, " ", len(self.tags)))
            known = self._known.get((up.role, tag, rest))
            if known is None:
                known = _element(up, tag, rest)
                if len(rest) < 1000:
                    if len(self._known) >= 50_000:
                        self._known.clear()
                    self._known[up.role, tag, rest] = known
            self.tags.append(known)
            if tag in _RAW:
                last = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                begin = at = last.end() if last else n
            elif tag not in _VOID and not (rest.endswith("/") and tag not in _BLOCK):
                self._open[tag].append(len(self._stack))
                if tag in _SCOPES:
                    self._scopes.append(len(self._stack))
                self._stack.append(known)
        self._text(source[begin : lt if lt >= 0 else n])

    def _cut(self, place: int) -> None:
        """Close all elements from this place of the stack on."""
        for e in self._stack[place:]:
            self._open[e.tag].pop()
        del self._stack[place:]
        while self._scopes[-1] >= place:
            self._scopes.pop()

    def _end(self, tag: str) -> None:
        """An end tag closes the nearest open element of its name; only a container's reaches through containers."""
        places = self._open[tag]
        if places and (tag in _SCOPES or places[-1] > self._scopes[-1]):
            self._cut(places[-1])

    def _implied(self, tags: tuple[str, ...], borders: tuple[str, ...]) -> None:
        last = lambda names: max((self._open[t][-1] for t in names if self._open[t]), default=0)
        if (place := last(tags)) > last(borders):
            self._cut(place)

    def _text(self, s: str, decode: bool = True) -> None:
        if s:
            self.texts.append((self._block, self._stack[-1], markup.unescape(s) if decode and "&" in s else s, len(self.tags)))

    def region(self) -> str:
        """The narrowest region that the page has outside its chrome."""
        kinds = {e.region for _, e, s, _ in self.texts if not e.chrome and e.region and not s.isspace()}
        return next((k for k in ("article", "main") if k in kinds), "")

    def keys(self) -> list[int]:
        """Token of each text; 0 for blank ones."""
        return [0 if s.isspace() else _h(e.role, " ".join(s.split())) for _, e, s, _ in self.texts]

    def slots(self, known: set[int]) -> dict[int, int]:
        """The slot of each role of the page: the nearest enclosing block-level role that the template knows, else 0."""
        out = {0: 0}
        for e in self.tags:  # parents come first
            if e.role not in out:
                out[e.role] = e.role if e.tag in _BLOCK and e.role in known else out[e.up]
        return out

    def main(self, e: Element, region: str) -> bool:
        """Does a text of this element stand in the page's narrowest region, outside chrome?"""
        return not e.chrome and (e.region == region or region == "main" and e.region == "article")

    def _boilerplate(self, state: list[str], strong: list[bool]) -> list[bool]:
        """Which texts of the template go. state: of each text '' (blank or elsewhere), 'menu', 'fixed' or 'own' (main text that changes).

        A text of the template that stands between the page's own texts is content, as is a heading among them, unless a menu
        follows. Before the first and after the last own text it goes; where the template outweighs the content (not strong), only from a
        container that holds no own text.
        """
        own = [i for i, x in enumerate(state) if x == "own"]
        if not own or "fixed" not in state:
            return [x == "fixed" and y for x, y in zip(state, strong, strict=True)]
        element = {e.role: e for e in self.tags}
        holds: set[int] = set()
        for i in own:
            role = self.texts[i][1].role
            while role and role not in holds:
                holds.add(role)
                role = element[role].up
        out, after = [False] * len(state), ""
        for i in range(len(state) - 1, -1, -1):
            if state[i] == "fixed":
                block = self.texts[i][1]
                while block.role and block.tag not in _BLOCK:
                    block = element.get(block.up, ROOT)
                container = element.get(block.up, ROOT)
                among = container.role in holds and container.tag not in ("", "html", "body")
                if own[0] < i < own[-1] or block.tag in _HEADINGS and i < own[-1] and among:
                    out[i] = after == "menu"
                else:
                    out[i] = strong[i] or container.role not in holds
            elif state[i]:
                after = state[i]
        return out

    def extract(self, known: set[int], menus: set[int], fixed: set[int], weak: set[int] = frozenset()) -> tuple[str, int]:
        """The text that template and chrome leave, a block each, and the number of texts that the template takes. fixed, weak: texts of the template,
        where it doesn't outweigh, or outweighs, the content of its pages."""
        region, slots = self.region(), self.slots(known)
        keys = self.keys() if fixed or weak else [0] * len(self.texts)
        said = {number for (number, e, s, _), key in zip(self.texts, keys, strict=True) if not s.isspace() and not (e.link and (key in fixed or key in weak))}
        state = []
        for (number, e, s, _), key in zip(self.texts, keys, strict=True):
            if s.isspace():
                state.append("")
            elif e.region != "article" and slots[e.role] in menus or (key in fixed or key in weak) and number not in said:  # a block of the template's links
                state.append("menu")
            elif key in fixed or key in weak:
                state.append("fixed" if self.main(e, region) else "")
            else:
                state.append("own" if self.main(e, region) else "")
        gone = self._boilerplate(state, [k in fixed for k in keys])
        blocks: dict[int, list[str]] = {}
        taken = 0
        for (number, e, s, _), x, key, out in zip(self.texts, state, keys, gone, strict=True):
            if x == "menu" or out or not x and (key in fixed or key in weak):
                taken += 1
            elif self.main(e, region) and not (s.isspace() and slots[e.role] in menus and e.region != "article"):
                blocks.setdefault(number, []).append(s)
        done = (_BLANK.sub(" ", "".join(b)).strip(" ") for b in blocks.values())
        return "\n\n".join(b for b in done if b), taken


def host_column():
    """Lower-case host of the url; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [k for k, _ in schema])


def occurrences(pages: DataFrame) -> DataFrame:
    """Per host and token (key): is it a tag, pages that hold it, fingerprint of its occurrence vector. Key 0 stands for the pages."""
    small_batches(pages.sparkSession)
    schema = [("host", pa.string()), ("key", pa.int64()), ("tag", pa.bool_()), ("n", pa.int64()), ("v", pa.int64()), ("w", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            found: dict[tuple[str, int], list] = {}
            for host, page_id, url, source in zip(*(c.to_pylist() for c in t.columns), strict=True):
                page = Page(source or "")
                own: dict[tuple[int, bool], int] = defaultdict(int)
                own[0, True] = 1
                for e in page.tags:
                    own[e.role, True] += 1
                for key in page.keys():
                    if key:
                        own[key, False] += 1
                marks: dict[int, int] = {}
                for (key, tag), count in own.items():
                    if count not in marks:
                        marks[count] = _h(page_id, url, count)
                    y = found.setdefault((host, key), [tag, 0, 0, 0])
                    y[1] += 1
                    y[2] += marks[count] & 0x7FFFFFFF
                    y[3] += marks[count] >> 31
            yield _batch([(h, k, x, n, v & 0x7FFFFFFF, w & 0xFFFFFFFF) for (h, k), (x, n, v, w) in found.items()], schema)

    parts = pages.select(host_column().alias("host"), "page_id", "url", "html").mapInArrow(tidy(run), "host string, key long, tag boolean, n long, v long, w long")
    vector = F.shiftleft(F.pmod(F.sum("v"), F.lit(1 << 31)), 32).bitwiseXOR(F.pmod(F.sum("w"), F.lit(1 << 32)))
    return parts.groupBy("host", "key", "tag").agg(F.sum("n").alias("n"), vector.alias("vector"))


def classes(stats: DataFrame) -> DataFrame:
    """host, tokens: (key, cls, tag) of the tokens in classes with enough support that hold a tag."""
    hosts = stats.filter("key = 0").select("host", F.col("n").alias("pages"))
    rows = stats.filter((F.col("key") != 0) & (F.col("n") >= LEAST_PAGES))
    groups = rows.groupBy("host", "n", "vector").agg(F.count_if("tag").alias("tags")).filter("tags > 0").join(hosts, "host")
    common, own = F.col("n") >= F.col("pages") * SUPPORT, (F.col("tags") >= LEAST_TAGS) & (F.col("n") >= F.col("pages") * RARE)
    valid = rows.join(groups.filter(common | own).select("host", "n", "vector"), ["host", "n", "vector"]).filter(F.col("tag") | (F.col("n") >= CONSTANT_PAGES))
    return valid.groupBy("host").agg(F.collect_list(F.struct("key", F.xxhash64("n", "vector").alias("cls"), "tag")).alias("tokens"))


def _with_hosts(pages: DataFrame, found: DataFrame, size: str, how: str) -> DataFrame:
    """pages (page_id, url, html, host) with the columns of their host's row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_column().alias("host"))
    # one row per host: broadcast while all are small, else AQE splits the join of a large host
    small = (found.agg(F.sum(F.expr(size))).first()[0] or 0) <= BROADCAST_TOKENS
    return rows.join(F.broadcast(found) if small else found, "host", how)


def checks(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Second reading, with the classes known. Per host and kind 'c' (class): order of its tokens (low = high if always the same), characters of its
    texts inside its tags (``fixed``, of these ``main`` are content by their place) and outside (``loose``), and of its pages' other content
    (``data``, with least and greatest digest); kind 's' (slot): characters, and those in links; kind 't': a text inside a tag of its class."""
    small_batches(pages.sparkSession)
    names = ["low", "high", "fixed", "main", "loose", "data", "first", "last", "chars", "links"]
    schema = [("host", pa.string()), ("kind", pa.string()), ("key", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), *((k, pa.int64()) for k in names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict, dict]] = {}
        for t in batches:
            out: dict[tuple, list[int]] = {}
            for source, host, tokens in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2), strict=True):
                if host not in held:
                    if len(held) > 1000:
                        held.clear()
                    every = tokens.as_py()
                    held[host] = {x["key"]: x["cls"] for x in every if x["tag"]}, {x["key"]: x["cls"] for x in every if not x["tag"]}
                tags, fixed = held[host]
                page = Page(source or "")
                region, slots, keys = page.region(), page.slots(tags.keys()), page.keys()
                up = {e.role: e.up for e in page.tags}
                inside: dict[tuple[int, int], bool] = {}

                def encloses(cls: int, role: int, tags=tags, up=up, inside=inside) -> bool:
                    """Does a tag of the class enclose the role? Answers are kept along the path."""
                    path = []
                    while role and (cls, role) not in inside and tags.get(role) != cls:
                        path.append(role)
                        role = up[role]
                    answer = inside.get((cls, role), role != 0)
                    inside.update(((cls, r), answer) for r in path)
                    return answer

                order: dict[int, list[int]] = defaultdict(list)
                sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
                at = data = digest = 0
                for (_, e, s, place), key in zip(page.texts, keys, strict=True):
                    for tag in page.tags[at:place]:
                        if tag.role in tags:
                            order[tags[tag.role]].append(tag.role)
                    at = place
                    if not key:
                        continue
                    cls = fixed.get(key)
                    if cls is not None:
                        order[cls].append(key)
                        if encloses(cls, e.role):
                            sums[cls][0] += len(s)
                            sums[cls][1] += len(s) * page.main(e, region)
                            out.setdefault((host, "t", key, cls), [0] * 11)
                            continue
                        sums[cls][2] += len(s)
                    if page.main(e, region):
                        data += len(s)
                        digest = digest + key & (1 << 62) - 1
                    if e.region != "article":
                        y = out.setdefault((host, "s", slots[e.role], 0), [0] * 11)
                        y[9] += len(s)
                        y[10] += len(s) * e.link
                for tag in page.tags[at:]:
                    if tag.role in tags:
                        order[tags[tag.role]].append(tag.role)
                for cls, seq in order.items():
                    times = seq.count(seq[0])
                    unit = seq[: len(seq) // times]
                    same = _h(*unit) if unit * times == seq else -1
                    y = out.setdefault((host, "c", 0, cls), [0, same, same, 0, 0, 0, 0, digest, digest, 0, 0])
                    y[0] += 1
                    y[1], y[2] = min(y[1], same), max(y[2], same)
                    if cls in sums:
                        for k, v in zip((3, 4, 5, 6), (*sums[cls], data), strict=True):
                            y[k] += v
                    y[7], y[8] = min(y[7], digest), max(y[8], digest)
            yield _batch([(*k, *v) for k, v in out.items()], schema)

    rows = _with_hosts(pages, found, "size(tokens)", "inner").select("html", "host", "tokens")
    parts = rows.mapInArrow(tidy(run), ", ".join(f"{k} {'string' if k in ('host', 'kind') else 'long'}" for k, _ in schema))
    least, most = ("low", "first"), ("high", "last")
    folded = [(F.min if k in least else F.max if k in most else F.sum)(k).alias(k) for k in ("n", *names)]
    return parts.groupBy("host", "kind", "key", "cls").agg(*folded)


def _template_texts():
    """How far a class's texts are template: 'fixed' if they don't outweigh the changing content of their pages, 'weak' if they do but are short
    and every page has content of its own; else, or if the class is more text than its tags enclose, its pages are copies."""
    weak = (F.col("main") <= F.col("n") * COPY_CHARS) & (F.col("first") < F.col("last"))
    return F.when(F.col("loose") <= F.col("fixed"), F.when(F.col("main") <= F.col("data") * OUTWEIGHS, "fixed").when(weak, "weak"))


def templates(pages: DataFrame) -> DataFrame:
    """host, known (roles of the template's tags), menus (slots that consist of links), fixed and weak (the template's texts, see _template_texts)."""
    found = cut(classes(cut(occurrences(pages), "html-tokens")), "html-classes")
    seen = cut(checks(pages, found), "html-checks")
    ordered = seen.filter("kind = 'c' AND low = high AND low >= 0")
    tokens = found.select("host", F.explode("tokens").alias("x")).select("host", "x.key", "x.cls", "x.tag")
    known = tokens.filter("tag").join(ordered, ["host", "cls"], "left_semi").select("host", F.lit("known").alias("sort"), "key")
    menus = seen.filter((F.col("kind") == "s") & (F.col("key") != 0) & (F.col("links") > F.col("chars") * LINK_SHARE)).select("host", F.lit("menus").alias("sort"), "key")
    fixed = seen.filter("kind = 't'").select("host", "cls", "key").join(ordered.select("host", "cls", _template_texts().alias("sort")).filter("sort IS NOT NULL"), ["host", "cls"]).select("host", "sort", "key")
    rows = known.unionByName(menus).unionByName(fixed).groupBy("host")
    return cut(rows.agg(*[F.array_sort(F.collect_list(F.when(F.col("sort") == k, F.col("key")))).alias(k) for k in ("known", "menus", "fixed", "weak")]), "html-templates")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, template_slots, template_texts for every row of pages.

    template_slots: tags of the host's template; template_texts: texts of the page that the template takes.
    """
    small_batches(pages.sparkSession)
    rows = _with_hosts(pages, templates(pages), "size(known) + size(menus) + size(fixed) + size(weak)", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[set, ...]] = {}
        for t in batches:
            done, sizes = [], []
            for source, host, *parts in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), *(t.column(k) for k in (4, 5, 6, 7)), strict=True):
                if host not in held:
                    if len(held) > 1000:
                        held.clear()
                    held[host] = tuple(set(p.as_py() or ()) for p in parts)
                done.append(Page(source or "").extract(*held[host]))
                sizes.append(len(held[host][0]))
            texts = [x for x, _ in done]
            columns = [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(sizes, pa.int64()), pa.array([x for _, x in done], pa.int64())]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), *columns], ["page_id", "url", "text", "n_chars", "template_slots", "template_texts"])

    schema = "page_id long, url string, text string, n_chars long, template_slots long, template_texts long"
    return rows.select("page_id", "url", "html", "host", "known", "menus", "fixed", "weak").mapInArrow(tidy(run), schema)
