"""Main text of web pages by wrappers of their hosts.

A wrapper is a regular expression without unions over the tags and texts of a host's pages. It
is found by aligning the pages' token streams one after another: what only one side has becomes
optional, neighbours that repeat become a repeated group, and every text becomes a slot. The
streams are kept as trees, so a group always is a whole element. Pages of one shape are aligned
once. Which slots hold the article is decided on the wrapper by the names of its elements and
by whether a slot's text is the same on the host's pages, and each page is read by it.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Collection, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze

MIN_PAGES = 3  # a text that is the same on fewer pages of a host tells nothing
TOGETHER = 64  # about so many wrappers of a host are aligned in one task of a round
RARE = 100  # a name is rare on a host where fewer than one page in so many has it

# Fixed values of HTML: elements without content, with raw content, and inside a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set(
    "script style textarea xmp iframe noembed noframes noscript template svg annotation "
    "annotation-xml".split()
)
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfrac mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom "
    "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
    "munderover none semantics".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section "
    "table ul".split()
)
CLOSED_BY_SIBLING = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
# Elements, and words in class, id or role, of what is not the article.
NOISE_TAGS = set(
    "head nav header footer aside form menu dialog button select input option fieldset "
    "object applet canvas audio video".split()
)
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs "
    "comment comments commentlist consent cookie cookies disclaimer disqus feedback "
    "footer gdpr header legal login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices notification overlay paginate pagination pager paywall popup "
    "promo promotion recommended related replies reply respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription teaser toolbar tracking "
    "widget widgets contentinfo complementary".split()
)
# A name is noise where it is or ends with such a word ("site-footer"), or begins with one and
# ends with a word for a part of a page ("share-buttons"), and says not that it only has one.
PARTS_OF_PAGES = set(
    "area banner bar block body bottom box button buttons column container content feed form "
    "group icon icons inner item items label left link links list main outer panel popup post "
    "posts right row section strip text title top unit wrap wrapper zone".split()
)
HAVING = set("has have with without no not is and above below after before".split())
# Headings and blocks of text are noise only where a class is one of the words of NOISE_WORDS
# that say that something is not the author's text.
TEXT_TAGS = set("h1 h2 h3 h4 h5 h6 p pre blockquote li dt dd td th figure figcaption".split())
TEXT_NOISE = set(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs cookie cookies "
    "comment comments login newsletter notice notices pagination pager paywall promo promotion "
    "share sharing signup skip sponsor sponsored subscribe tracking".split()
)
MAIN_WORDS = set(
    "article articlebody blogpost body content entry main maincontent post story text".split()
)

# Comments, sections and declarations, or the start of a tag, whose end `_Tags` finds.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/><]*)|<[/a-zA-Z][^<]*\Z",
    re.S,
)
_STOP = re.compile(r"[>\"']")
MAX_DEPTH = 100  # blocks; what lies deeper counts to the block at that depth
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_WORDS = re.compile(r"[a-z]+")
_NAMED = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


class _Tags:
    """Ends of the tags of a page, in time that grows with the page alone.

    A tag ends at the first ">" outside of quoted values; a quote that nothing closes is no
    quote. A search that comes to the page's end without one is kept: a later tag that starts
    where that search stood outside of quotes would end the same way. Searches that stand at one
    place in one state go on alike, so there are three such searches at most.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.vain: list[tuple[int, list[int], list[int]]] = []

    def end(self, at: int) -> int:
        """The place after the tag that goes on at `at`, or -1."""
        for start, opened, closed in self.vain:
            i = bisect_right(opened, at) - 1
            if at >= start and (i < 0 or at >= closed[i]):
                return self._plain(at)
        opened, closed, here = [], [], at
        while (stop := _STOP.search(self.page, here)) is not None:
            here = stop.end()
            if stop[0] == ">":
                return here
            if here <= self.last[stop[0]]:
                opened.append(stop.start())
                here = self.page.find(stop[0], here) + 1
                closed.append(here)
        self.vain.append((at, opened, closed))
        return self._plain(at)

    def _plain(self, at: int) -> int:
        """Without regard to quotes."""
        return self.page.find(">", at) + 1 or -1


def _label(tag: str, attrs: str) -> str:
    """The tag with the names in its class, id, role and itemprop, as words and numbers joined by "-".

    Headings and text blocks go without their ids, which name what the text is about.
    """
    if not attrs or attrs.isspace():
        return tag
    found = set()
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        if name in ("class", "role", "itemprop") or (name == "id" and tag not in TEXT_TAGS):
            for one in value.strip("\"'").split():
                words = _NAMED.findall(_CAMEL.sub(" ", one).lower())
                if words:
                    found.add("-".join(words))
    if _HIDDEN.search(attrs):
        found.add("hidden")
    return ".".join([tag, *sorted(found)])


def parse(page: str) -> tuple[list, list[tuple[str, str, int]]]:
    """The tree of a page's blocks, and its texts in order as (path, text, characters of links).

    A tree is [label, children]; a text in it is "#". Only elements that form blocks stand in
    the tree. What is left open closes where HTML closes it, at the latest at the page's end.
    Blocks below `MAX_DEPTH` have their text in the block at that depth.
    """
    root: list = ["", []]
    stack, paths, tags, open_tags = [root], [""], [""], Counter()
    ends = _Tags(page)
    texts: list[tuple[str, str, int]] = []
    held: list[str] = []
    links, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            texts.append((paths[-1], text, links))
            if not stack[-1][1] or stack[-1][1][-1] != "#":
                stack[-1][1].append("#")
        links = 0

    def close(depth: int) -> None:
        open_tags.subtract(tags[depth:])
        del stack[depth:], paths[depth:], tags[depth:]

    def last(tag: str) -> int:
        """The innermost open element with this tag; 0 if none is open."""
        i = len(tags) - 1 if open_tags[tag] else 0
        while i and tags[i] != tag:
            i -= 1
        return i

    def take(raw: str) -> None:
        nonlocal links
        text = html.unescape(raw)
        held.append(text)
        if in_link:
            links += len(text.strip())

    while True:
        found = _TOKEN.search(page, at)
        if found is None:
            take(page[at:])
            break
        take(page[at : found.start()])
        at = found.end()
        if found[0].startswith("<![CDATA["):
            take(html.escape(found[0][9:].removesuffix("]]>"), quote=False))
            continue
        if found[2] is None:
            continue
        end = ends.end(at)
        if end < 0:
            # No tag ends any more: the last one is cut off, what stands before is text.
            cut = page.rfind("<", at)
            take(page[found.start() : cut] if cut >= 0 else "")
            break
        attrs, at = page[at : end - 1], end
        tag = found[2].lower()
        if found[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag not in INLINE:
                flush()
                if open_ := last(tag):
                    close(open_)
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                held.append(" " if tag == "br" else "")
            elif tag == "a":
                in_link += 1
            continue
        flush()
        in_link = 0
        if tag in CLOSES_P and (open_ := last("p")):
            close(open_)
        elif tag in CLOSED_BY_SIBLING and any(open_tags[t] for t in CLOSED_BY_SIBLING[tag]):
            for i in range(len(tags) - 1, 0, -1):
                if tags[i] in CLOSED_BY_SIBLING[tag]:
                    close(i)
                    break
                if tags[i] in ("ul", "ol", "dl", "table", "select"):
                    break
        node, path = stack[-1], paths[-1]
        if len(stack) <= MAX_DEPTH:
            label = _label(tag, attrs)
            node, path = [label, []], f"{path}/{label}"
            stack[-1][1].append(node)
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
            paths.append(path)
            tags.append(tag)
            open_tags[tag] += 1
    flush()
    return root, texts


def _shape(tree) -> str:
    return "#" if tree == "#" else f"{tree[0]}({' '.join(map(_shape, tree[1]))})"


def wrapper_of(tree: list) -> list:
    """A page's own wrapper: [label, optional, repeated, children], repeats folded."""
    return ["", False, False, _folded([_node(c) for c in tree[1]])]


def _node(tree) -> list:
    if tree == "#":
        return ["#", False, False, []]
    return [tree[0], False, False, _folded([_node(c) for c in tree[1]])]


def _folded(nodes: list) -> list:
    """Neighbours with the same label become one repeated group."""
    out: list = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            out[-1] = _joined(out[-1], node)
            out[-1][2] = True
        else:
            out.append(node)
    # Groups of two or three different elements that come again and again.
    for period in (2, 3):
        i = 0
        while i + 2 * period <= len(out):
            here, next_ = out[i : i + period], out[i + period : i + 2 * period]
            if [n[0] for n in here] == [n[0] for n in next_]:
                for j in range(period):
                    out[i + j] = _joined(here[j], next_[j])
                    out[i + j][2] = True
                del out[i + period : i + 2 * period]
            else:
                i += 1
    return out


def _joined(a: list, b: list) -> list:
    """The wrapper that reads what `a` and `b` read; both have the same label."""
    return [a[0], a[1] or b[1], a[2] or b[2], aligned(a[3], b[3])]


def aligned(a: list, b: list) -> list:
    """Align two lists of elements; what only one has becomes optional."""
    names = [n[0] for n in a], [n[0] for n in b]
    if names[0] == names[1]:
        return [_joined(x, y) for x, y in zip(a, b, strict=True)]
    out: list = []
    for kind, i, k, j, m in SequenceMatcher(None, *names, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [_joined(x, y) for x, y in zip(a[i:k], b[j:m], strict=True)]
        else:
            out += [[n[0], True, n[2], n[3]] for n in (*a[i:k], *b[j:m])]
    return out


def pattern(wrapper: list) -> str:
    """A wrapper as a regular expression over tags and #, the text slot."""
    label, optional, repeated, children = wrapper
    inner = "".join(map(pattern, children))
    body = "#" if label == "#" else f"<{label}>{inner}</{label}>" if label else inner
    if optional or repeated:
        body = f"({body}){'*' if optional and repeated else '?' if optional else '+'}"
    return body


def _names_noise(name: str, inside_article: bool) -> bool:
    words = _WORDS.findall(name)
    if not words or HAVING & set(words[:-1]):
        return False
    noise = NOISE_WORDS - {"header"} if inside_article else NOISE_WORDS
    return words[-1] in noise or (words[0] in noise and words[-1] in PARTS_OF_PAGES)


def _decides(tag: str, name: str) -> set[str]:
    """Names of a fixed vocabulary that decide on an element as `name` does."""
    words = _WORDS.findall(name)
    out = MAIN_WORDS & set(words)
    if tag in TEXT_TAGS:
        return out | ({"-".join(words)} & TEXT_NOISE)
    if words and not HAVING & set(words[:-1]):
        if words[-1] in NOISE_WORDS:
            out.add(words[-1])
        elif words[0] in NOISE_WORDS and words[-1] in PARTS_OF_PAGES:
            out.add(f"{words[0]}-{words[-1]}")
    return out


def _common(label: str, names: Collection[str]) -> str:
    """A label in which names that are not in `names` leave only what decides."""
    tag, *named = label.split(".")
    out: set[str] = set()
    for name in named:
        out |= {name} if name in names or name == "hidden" else _decides(tag, name)
    return ".".join([tag, *sorted(out)])


def _relabelled(node: list, names: Collection[str]) -> list:
    label, optional, repeated, children = node
    inner = _folded([_relabelled(c, names) for c in children])
    return [_common(label, names), optional, repeated, inner]


def _noise(label: str, inside_article: bool) -> bool:
    tag, *named = label.split(".")
    if "hidden" in named or (tag in NOISE_TAGS and not (tag == "header" and inside_article)):
        return True
    if tag in TEXT_TAGS:
        return any("-".join(_WORDS.findall(name)) in TEXT_NOISE for name in named)
    # Reader comments are often article elements too.
    kept = tag in ("html", "body", "main")
    return not kept and any(_names_noise(name, inside_article) for name in named)


def _kind(label: str) -> int:
    """How clearly an element says that it holds the article; 0: not at all."""
    tag, *names = label.split(".")
    named = {word for name in names for word in _WORDS.findall(name)}
    if tag == "article" or "articlebody" in named:
        return 3
    if tag == "main" or "main" in named or "maincontent" in named:
        return 2
    return int(tag in ("div", "section", "td") and bool(MAIN_WORDS & named))


def _holds(node: list) -> int:
    """The clearest kind of the single elements in a node that are no noise themselves."""
    best = 0
    for child in node[3]:
        if child[0] != "#" and not child[2]:
            tag = child[0].partition(".")[0]
            if tag not in NOISE_TAGS or tag == "form":
                own = 0 if _noise(child[0], False) else _kind(child[0])
                best = max(best, own, _holds(child))
    return best


def main_paths(wrapper: list, constant: Collection[str] = ()) -> list[str]:
    """Paths of the elements whose text slots hold the article.

    Inside the elements that say most clearly that they are the article, and where none does
    in the whole page; leaving out menus, headers, footers, sidebars, notices, adverts, forms
    and comments. An element that holds the only article is never left out for its name.
    Slots in `constant` hold the same text on the host's pages and are left out where no
    article element says that they belong to it, unless no slot would be left.
    """

    def visit(node: list, path: str, best: int, opened: int) -> None:
        for child in node[3]:
            tag, *named = child[0].split(".")
            if child[0] == "#":
                slots.append((path, best))
            elif not _noise(child[0], best == 3):
                visit(child, f"{path}/{child[0]}", max(best, _kind(child[0])), opened)
            elif opened and "hidden" not in named and (tag not in NOISE_TAGS or tag == "form"):
                if _holds(child) == opened:
                    visit(child, f"{path}/{child[0]}", best, opened)

    slots: list[tuple[str, int]] = []
    visit(wrapper, "", 0, 0)
    top = max((k for _, k in slots), default=0)
    if top == 0 and (opened := _holds(wrapper)):
        # The article stands in an element that is named like noise: a layout, or a form.
        slots.clear()
        visit(wrapper, "", 0, opened)
        top = max((k for _, k in slots), default=0)
    varied = [(path, kind) for path, kind in slots if kind == 3 or path not in constant]
    if varied and len(varied) < len(slots):
        slots, top = varied, max(k for _, k in varied)
    return sorted({path for path, kind in slots if kind == top})


KINDS = "host string, wrapper string, pages long"


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def shapes_of(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Written rows (host, wrapper as JSON, pages): the pages' own wrappers with all names."""

    def shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: dict[tuple[str, str], int] = {}
            for host, page in zip(frame["host"], frame["page"], strict=True):
                own = json.dumps(wrapper_of(parse(page)[0]), ensure_ascii=False)
                found[host, own] = found.get((host, own), 0) + 1
            rows = [(host, own, n) for (host, own), n in found.items()]
            yield pd.DataFrame(rows, columns=["host", "wrapper", "pages"])

    rows = pages.select(
        _host(F.col(url_col)).alias("host"),
        F.coalesce(F.col(html_col), F.lit("")).alias("page"),
    )
    each = rows.mapInPandas(shapes, KINDS).groupBy("host", "wrapper")
    return freeze(each.agg(F.sum("pages").alias("pages")), "page-shapes")


def host_names(shapes: DataFrame) -> DataFrame:
    """One row per host: host and names (array), those that two pages and one in `RARE` have.

    They are at most `RARE` times as many as a page has names, however many pages there are.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def visit(node: list, found: set[str]) -> set[str]:
            found.update(node[0].split(".")[1:])
            for child in node[3]:
                visit(child, found)
            return found

        for frame in frames:
            found: dict[tuple[str, str], int] = {}
            for host, own, n in zip(frame["host"], frame["wrapper"], frame["pages"], strict=True):
                # No name is "*", which stands for the page.
                for name in visit(json.loads(own), {"*"}):
                    found[host, name] = found.get((host, name), 0) + n
            rows = [(host, name, n) for (host, name), n in found.items()]
            yield pd.DataFrame(rows, columns=["host", "name", "n"])

    counted = shapes.mapInPandas(count, "host string, name string, n long")
    counted = counted.groupBy("host", "name").agg(F.sum("n").alias("n"))
    every = counted.filter("name = '*'").select("host", F.col("n").alias("pages"))
    often = counted.filter("name <> '*' AND n > 1").join(every, "host")
    often = often.filter(RARE * F.col("n") >= F.col("pages"))
    held = often.groupBy("host").agg(F.collect_list("name").alias("names"))
    none = F.array().cast("array<string>")
    out = every.join(held, "host", "left").select("host", F.coalesce("names", none).alias("names"))
    return freeze(out, "host-names")


def wrappers(shapes: DataFrame, names: DataFrame) -> DataFrame:
    """One row per host: host, wrapper (JSON) and pages.

    Pages of a host that have the same shape, but for rare names, are one row before anything
    is aligned. The shapes of a host are aligned in rounds, about `TOGETHER` in a group.
    """

    def rename(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = [
                json.dumps(_relabelled(json.loads(w), set(n)), ensure_ascii=False)
                for w, n in zip(frame["wrapper"], frame["names"], strict=True)
            ]
            yield pd.DataFrame({"host": frame["host"], "wrapper": own, "pages": frame["pages"]})

    def align(group: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for own in sorted(group["wrapper"]):
            one = json.loads(own)
            whole = one if whole is None else _joined(whole, one)
        text = json.dumps(whole, ensure_ascii=False)
        return pd.DataFrame(
            {"host": [group["host"].iloc[0]], "wrapper": [text], "pages": [group["pages"].sum()]}
        )

    rows = shapes.join(names, "host").mapInPandas(rename, KINDS)
    while True:
        rows = rows.groupBy("host", "wrapper").agg(F.sum("pages").alias("pages"))
        rows = freeze(rows, "wrappers")
        counts = rows.groupBy("host").agg(F.count("*").alias("shapes"))
        if (counts.agg(F.max("shapes")).first()[0] or 0) <= 1:
            return rows
        part = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("shapes") / TOGETHER))
        rows = rows.join(counts, "host").withColumn("part", part).drop("shapes")
        rows = rows.groupBy("host", "part").applyInPandas(align, KINDS)


def constant_slots(
    pages: DataFrame, names: DataFrame, url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per host that has such slots: host and constant (array of paths).

    A slot is constant where more than half of the host's pages, `MIN_PAGES` at least, have
    it, all with the same texts, though the pages themselves differ. Only counts, least and
    greatest hashes per host and path leave a task.
    """

    def slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: dict[tuple[str, str], list[int]] = {}
            for host, page in zip(frame["host"], frame["page"], strict=True):
                held: dict[str, list[str]] = {}
                for path, text, _ in parse(page)[1]:
                    held.setdefault(path, []).append(text)
                every = zlib.crc32(page.encode("utf-8", "replace"))
                # No path of a slot is "*", which stands for the page.
                for path, texts in (*held.items(), ("*", [])):
                    own = zlib.crc32("\n".join(texts).encode("utf-8", "replace"))
                    own = own << 31 | len(texts) % (1 << 31)
                    n, a, b, c, d = found.get((host, path), (0, own, own, every, every))
                    found[host, path] = [
                        n + 1, min(a, own), max(b, own), min(c, every), max(d, every)
                    ]
            rows = [(host, path, *x) for (host, path), x in found.items()]
            yield pd.DataFrame(rows, columns=cols)

    def rename(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            paths = [
                "/".join(_common(label, set(n)) for label in path.split("/"))
                for path, n in zip(frame["path"], frame["names"], strict=True)
            ]
            yield frame[cols].assign(path=paths)

    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("host", "path").agg(
            F.sum("n").alias("n"), F.min("text_min").alias("text_min"),
            F.max("text_max").alias("text_max"), F.min("page_min").alias("page_min"),
            F.max("page_max").alias("page_max"),
        )

    cols = ["host", "path", "n", "text_min", "text_max", "page_min", "page_max"]
    kinds = "host string, path string, n long, text_min long, text_max long, page_min long, page_max long"
    rows = pages.select(
        _host(F.col(url_col)).alias("host"),
        F.coalesce(F.col(html_col), F.lit("")).alias("page"),
    )
    full = merged(rows.mapInPandas(slots, kinds)).join(names, "host")
    each = merged(full.mapInPandas(rename, kinds))
    same = (F.col("text_min") == F.col("text_max")) & (F.col("page_min") < F.col("page_max"))
    fixed = F.when(same & (F.col("path") != "*"), F.struct("n", "path"))
    whole = each.groupBy("host").agg(
        F.max(F.when(F.col("path") == "*", F.col("n"))).alias("pages"),
        F.collect_list(fixed).alias("fixed"),
    )
    often = F.filter("fixed", lambda x: (x["n"] >= MIN_PAGES) & (2 * x["n"] > F.col("pages")))
    return whole.select("host", F.transform(often, lambda x: x["path"]).alias("constant")).filter(
        F.size("constant") > 0
    )


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host: host, names and wanted (array of paths whose texts are the article)."""
    shapes = shapes_of(pages, url_col, html_col)
    names = host_names(shapes)
    constant = constant_slots(pages, names, url_col, html_col)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            wanted = [
                main_paths(json.loads(wrapper), set(() if fixed is None else fixed))
                for wrapper, fixed in zip(frame["wrapper"], frame["constant"], strict=True)
            ]
            yield pd.DataFrame({"host": frame["host"], "wanted": wanted})

    both = wrappers(shapes, names).join(constant, "host", "left")
    wanted = both.select("host", "wrapper", "constant").mapInPandas(
        choose, "host string, wanted array<string>"
    )
    return wanted.join(names, "host")


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: its id, url, text (main text, blocks joined by line feeds), n_chars,
    host and blocks.

    Null and empty pages, and pages without an article text, give an empty text. A null or odd
    url has the host ''. A page in which its host's wrapper finds nothing is read by a wrapper
    of its own. Repeated rows are extracted alike; an empty table gives an empty one. Other
    columns are not read.
    """
    found = host_paths(pages, url_col, html_col).select(F.col("host").alias("of"), "wanted", "names")
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).alias("url"),
        _host(F.col(url_col)).alias("host"),
        F.col(html_col).alias("page"),
    )
    joined = rows.join(found, F.col("host") == F.col("of")).drop("of")
    id_kind = dict(joined.dtypes)["id"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[set[str], set[str], dict[str, str]]] = {}
        for frame in frames:
            texts, blocks = [], []
            for host, page, paths, names in zip(
                frame["host"], frame["page"], frame["wanted"], frame["names"], strict=True
            ):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = set(paths), set(names), {"": ""}
                wanted, common, renamed = known[host]
                tree, slots = parse(page or "")
                kept = []
                for path, text, _ in slots:
                    if path not in renamed:
                        if len(renamed) > 10_000:
                            renamed.clear()
                        renamed[path] = "/".join(_common(x, common) for x in path.split("/"))
                    if renamed[path] in wanted:
                        kept.append(text)
                if not kept and slots:
                    wanted = set(main_paths(wrapper_of(tree)))
                    kept = [text for path, text, _ in slots if path in wanted]
                texts.append("\n".join(kept))
                blocks.append(len(kept))
            out = frame[["id", "url", "host"]].assign(text=texts, blocks=blocks)
            yield out

    kinds = f"id {id_kind}, url string, host string, text string, blocks int"
    out = joined.mapInPandas(read, kinds)
    return out.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text",
        F.length("text").cast("long").alias("n_chars"), "host", "blocks",
    )
