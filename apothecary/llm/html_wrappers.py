"""Main text of web pages through wrappers inferred for each host.

A wrapper is a union-free regular expression over tags: elements, optional
and repeated groups, and text slots, with no alternatives. It starts as one
page's token stream. Every further page of the host is aligned with it;
siblings found once in one and not in the other become optional, runs of like
siblings become repeated groups, and text that differs becomes a slot. Pages
are dealt by their text and folded inside each task first, so a host with a
third of all pages sends a few partial wrappers only, which are aligned with
each other in turn. Every slot carries the number of different pages that
hold it; exact copies, and pages that differ in their menus only, are one.

A page is read with its host's wrapper. What lies inside an article is the
article's, whatever other pages say. Of a page without one, the wrapper tells
the template: text that it holds as a mandatory, constant part beside parts
that vary, and repeated groups of nothing but links. Menus, footers and the
like are told by their tags and class words everywhere.
"""

from __future__ import annotations

import hashlib
import html
import json
import operator
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apothecary.llm.common import chosen, shuffle_partitions, slices, stored

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(script|style|noscript|template|svg|iframe|textarea|title)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_BLOCKS_CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_SIDE_TAGS = frozenset("nav footer aside form button select dialog menu head object applet audio video canvas".split())
_SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo search alert".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_DEEPEST = 150  # of an element nested deeper, the tree and the paths hold its nearest ancestors' kind only
_LONGEST = 64  # siblings after folding; of longer rows each tag is one repeated group
Node = list  # [tag, many, children] for an element, ["#", many, text hash or None, pages] for a slot; many: "1", "?", "+" or "*"


def _words(attributes: str) -> list[str]:
    """Words of class, id and role; names with digits, which are often one page's own, are left out."""
    values = " ".join(m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes)).lower()
    return sorted({w for name in values.split() if not any(c.isdigit() for c in name) for w in re.split(r"[^a-z]+", name) if w})


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def blocks(page: str, title: list[str] | None = None) -> tuple[list[Node], list[tuple[str, str]]]:
    """A page's tree of block elements, and its text blocks in order, each with the path of its slot.

    ``title`` takes the page's title.

    Inline tags belong to the text around them; a line break is white space.
    A block that lies inside links as a whole hangs from an element ``a``.
    Unclosed paragraphs, items and cells end where the next begins. All open
    elements are kept; those below the depth of the tree hang, each as one
    element that tells menu, article and other text apart, from the deepest.
    """
    root: list = ["", "1", []]
    stack, names, opened, texts, run, at = [root], [""], Counter(), [], [], 0
    linking, plain = False, False

    def end_text() -> None:
        nonlocal plain, linking
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            slot, path = ["#", "1", _hash(text), 1], [n[0] for n in (stack[1:] if len(stack) <= _DEEPEST else [*stack[1:_DEEPEST], stack[-1]])]
            stack[-1][2].append(slot if plain else ["a", "1", [slot]])
            texts.append(("/".join(path if plain else [*path, "a"]), text))
        plain = linking = False  # a link left open ends with its block

    def end_element() -> None:
        stack.pop()
        opened[names.pop()] -= 1

    for match in _TOKEN.finditer(page):
        if match.start() > at:
            run.append(page[at : match.start()])
            plain = plain or (not linking and not run[-1].isspace())
        at = match.end()
        raw, close, name = match.group(1), match.group(2), (match.group(3) or "").lower()
        if raw or not name:
            if raw:
                run.append(" ")
                if title is not None and raw.lower() == "title":
                    title.append(match.group(0))
            continue
        if name in _INLINE:
            if name == "a":
                linking = not close and "href" in match.group(4).lower()
            continue
        if name in _VOID:
            if name == "hr":
                end_text()
            else:
                run.append(" ")
            continue
        end_text()
        if close:
            if opened[name]:
                while names[-1] != name:
                    end_element()
                end_element()
            continue
        ends = _CLOSES.get(name, {"p"} if name in _BLOCKS_CLOSE_P else ())
        while len(stack) > 1 and names[-1] in ends:
            end_element()
        named = _words(match.group(4)) if "=" in match.group(4) else []
        node = [".".join([name, *named]), "1", []]
        if len(stack) >= _DEEPEST:
            node[0] = _kind([*(n[0] for n in (stack[1:] if len(stack) == _DEEPEST else stack[-1:])), node[0]])
        stack[min(len(stack), _DEEPEST) - 1][2].append(node)
        if not match.group(4).rstrip().endswith("/"):
            stack.append(node)
            names.append(name)
            opened[name] += 1
    if at < len(page):
        run.append(page[at:])
        plain = plain or (not linking and not run[-1].isspace())
    end_text()
    return root[2], texts


def _shape(node: Node) -> str:
    return "#" if node[0] == "#" else f"<{node[0]}>{''.join(map(_shape, node[2]))}"


def _more(a: str, b: str) -> str:
    """How often, if two aligned places ask for ``a`` and ``b``."""
    return {(False, False): "1", (True, False): "?", (False, True): "+", (True, True): "*"}[(a in "?*" or b in "?*", a in "+*" or b in "+*")]


def _one(a: Node, b: Node, pages: Callable[[int, int], int]) -> Node:
    """Both as one; ``pages`` joins their slots' counts: a sum for different pages, max within the same pages."""
    if a[0] == "#":
        return ["#", _more(a[1], b[1]), a[2] if a[2] == b[2] else None, pages(a[3], b[3])]
    return [a[0], _more(a[1], b[1]), align(a[2], b[2], pages)]


def generalise(nodes: list[Node]) -> list[Node]:
    """A page's siblings with every run of like elements as one repeated group."""
    out: list[Node] = []
    for node in nodes:
        if node[0] != "#":
            node = [node[0], "1", generalise(node[2])]
        if out and out[-1][0] == node[0]:
            out[-1] = _one(out[-1], node, max)
            out[-1][1] = "+"
        else:
            out.append(node)
    return _by_tag(out) if len(out) > _LONGEST else out


def _by_tag(nodes: list[Node]) -> list[Node]:
    """Each tag of a long row once, as a repeated group, in order of first appearance."""
    found: dict[str, Node] = {}
    for node in nodes:
        if node[0] in found:
            many = found[node[0]][1]
            found[node[0]] = _one(found[node[0]], node, max)
            found[node[0]][1] = "*" if "*" in (many, node[1]) or "?" in (many, node[1]) else "+"
        else:
            found[node[0]] = node
    return list(found.values())


def align(a: list[Node], b: list[Node], pages: Callable[[int, int], int] = operator.add) -> list[Node]:
    """One sequence that takes both: longest common subsequence of tags, the rest optional."""
    m, n = len(a), len(b)
    if max(m, n) > 4 * _LONGEST:
        found = {node[0]: node for node in _by_tag(a)}
        for node in _by_tag(b):
            if node[0] in found:
                node = _one(found[node[0]], node, pages)
                node[1] = "*" if node[1] in "?*" else "+"
            found[node[0]] = node
        return list(found.values())
    common = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m - 1, -1, -1):
        for j in range(n - 1, -1, -1):
            common[i][j] = common[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(common[i + 1][j], common[i][j + 1])
    out, i, j = [], 0, 0
    while i < m or j < n:
        if i < m and j < n and a[i][0] == b[j][0]:
            out.append(_one(a[i], b[j], pages))
            i, j = i + 1, j + 1
        elif j >= n or (i < m and common[i + 1][j] >= common[i][j + 1]):
            out.append([a[i][0], _more(a[i][1], "?"), *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], _more(b[j][1], "?"), *b[j][2:]])
            j += 1
    joined: list[Node] = []
    for node in out:  # neighbours of one tag are one repeated group
        if joined and joined[-1][0] == node[0]:
            joined[-1] = _one(joined[-1], node, max)
            joined[-1][1] = "*" if "?" in (joined[-1][1], node[1]) or joined[-1][1] == "*" else "+"
        else:
            joined.append(node)
    return joined


def expression(nodes: list[Node]) -> str:
    """The wrapper as text, e.g. ``<body>(<nav>#"..."</nav>)?(<p>#</p>)+</body>``."""
    out = []
    for tag, many, inner, *_ in nodes:
        body = ("#" if inner is None else f"#{inner:08x}") if tag == "#" else f"<{tag}>{expression(inner)}</{tag.split('.')[0]}>"
        out.append(body if many == "1" else f"({body}){many}")
    return "".join(out)


def _uncounted(nodes: list[Node]) -> list[Node]:
    """The same for a page whose text is counted already."""
    return [[*node[:3], 0] if node[0] == "#" else [node[0], node[1], _uncounted(node[2])] for node in nodes]


def _aside(path: list[str]) -> bool:
    """Whether a slot's elements mark it as menu, header, footer, sidebar, notice, advert, form or comments."""
    inside = False
    for element in path:
        name, *words = element.split(".")
        if name in _SIDE_TAGS or (name == "header" and not inside):
            return True
        if name not in _HEADINGS and name not in ("html", "body", "article", "main") and _SIDE_NAMES.intersection(words):
            return True
        inside = inside or name in ("article", "main") or "main" in words
    return False


def _within(path: list[str]) -> bool:
    return any(e.split(".")[0] in ("article", "main") or "main" in e.split(".")[1:] for e in path)


def _kind(path: list[str]) -> str:
    """One element that stands for a path."""
    return "aside" if _aside(path) else "main" if _within(path) else "div"


@lru_cache(maxsize=20_000)
def _part(path: str) -> str:
    """``aside``, ``main`` or ``div`` for a slot's path."""
    return _kind(path.split("/") if path else [])


def template(wrapper: list[Node]) -> tuple[set[tuple[str, int]], set[str]]:
    """What a wrapper takes for a host's template on pages without an article: fixed texts, by path and hash, and paths of links.

    A text is fixed if it is constant and neither it nor an element around it
    is optional, in a wrapper that has text beside it that varies or is
    optional. A constant heading stays if the next text that is no heading
    varies or stays itself. Links go if they stand in a repeated group with
    nothing but links in it; a path that occurs outside such a group stays.
    """
    slots: list[tuple[str, int | None, bool, bool]] = []  # path, constant text, mandatory, of a repeated group of links

    def only_links(node: Node) -> bool:
        return node[0] == "a" or (node[0] != "#" and all(map(only_links, node[2])))

    def walk(nodes: list[Node], path: str, mandatory: bool, links: bool) -> None:
        for node in nodes:
            always = mandatory and node[1] in "1+"
            if node[0] == "#":
                if _part(path) == "div":
                    slots.append((path, node[2], always, links))
            else:
                walk(node[2], f"{path}/{node[0]}" if path else node[0], always, links or (node[1] in "+*" and only_links(node)))

    walk(wrapper, "", True, False)
    links = {path for path, *_, linked in slots if linked} - {path for path, *_, linked in slots if not linked}
    fixed: set[tuple[str, int]] = set()
    kept = False  # whether the next text that is no heading stays
    for path, text, mandatory, _ in reversed(slots):
        if path in links:
            continue
        goes = mandatory and text is not None
        if not any(e.split(".")[0] in _HEADINGS for e in path.split("/")):
            kept = not goes
        elif goes and kept:
            continue
        if goes:
            fixed.add((path, text))
    varies = any(path not in links and not (mandatory and text is not None) for path, text, mandatory, _ in slots)
    return (fixed, links) if varies else (set(), set())


def _slot(path: str, text: str = "") -> int:
    """A name for a slot, or for one of its texts."""
    return xxhash.xxh3_64_intdigest(f"{path}\n{text}".encode("utf-8", "replace")) - 2**63


def page_text(texts: list[tuple[str, str]], fixed: set[tuple[str, int]], links: set[str]) -> str:
    """Blocks of the main part: all inside the article if the page has one, else the rest but the host's template."""
    article = [text for path, text in texts if _part(path) == "main"]
    return "\n\n".join(article or [text for path, text in texts if _part(path) == "div" and path not in links and (path, _hash(text)) not in fixed])


def _body(texts: list[tuple[str, str]]) -> int:
    """Key of a page's text without menus and the like; pages with the same key count as one."""
    main = [t for path, t in texts if not _aside(path.split("/"))]
    return int.from_bytes(hashlib.blake2b("\n".join(main).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _page_key(texts: list[tuple[str, str]], title: list[str]) -> int:
    """Pages of one key count as one: those of one title and headline, which are versions of one page; without either, those of one text."""
    headline = [t for path, t in texts if path.removesuffix("/a").rsplit("/", 1)[-1].split(".")[0] == "h1"][:1]
    return _slot("\n".join(title), "".join(headline)) if title or headline else _body(texts)


def infer_wrappers(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """One row a host: host, wrapper (as JSON), pages (rows) and bodies (different pages)."""

    def packed(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each different page of a few thousand once, with its number of rows."""
        names, types = ["host", "body", "tree", "pages"], [pa.string(), pa.int64(), pa.string(), pa.int64()]
        found: dict = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                title: list[str] = []
                tree, texts = blocks(page or "", title)
                key = (host, _page_key(texts, title), json.dumps(generalise(tree), separators=(",", ":")))
                found[key] = found.get(key, 0) + 1
            if len(found) > 5000:
                yield packed([(*k, n) for k, n in found.items()], names, types)
                found.clear()
        yield packed([(*k, n) for k, n in found.items()], names, types)

    def folded(found: dict) -> pa.RecordBatch:
        rows = [(host, json.dumps(w, separators=(",", ":")), *counts) for host, (w, *counts) in found.items()]
        return packed(rows, ["host", "wrapper", "pages", "bodies"], [pa.string(), pa.string(), pa.int64(), pa.int64()])

    def add(found: dict, host: str | None, new: list[Node], pages: int, bodies: int) -> None:
        if host not in found:
            found[host] = [new, pages, bodies]
            return
        entry = found[host]
        entry[0], entry[1], entry[2] = align(entry[0], new), entry[1] + pages, entry[2] + bodies

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        last = seen = None
        for batch in batches:
            for host, body, tree, pages in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (host, body, tree) == last:  # sorted: the same page from another task
                    found[host][1] += pages
                    continue
                if found and host not in found and len(found) > 5000:
                    yield folded(found)
                    found.clear()
                new = json.loads(tree)
                counted = (host, body) == seen
                add(found, host, _uncounted(new) if counted else new, pages, 0 if counted else 1)
                last, seen = (host, body, tree), (host, body)
        yield folded(found)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for host, wrapper, pages, bodies in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if found and host not in found:  # sorted by host
                    yield folded(found)
                    found.clear()
                add(found, host, json.loads(wrapper), pages, bodies)
        if found:
            yield folded(found)

    rows = chosen(pages, host=host_col, html=html_col)
    different = rows.mapInArrow(trees, "host string, body long, tree string, pages long")
    partial = different.repartition("host", "body").sortWithinPartitions("host", "body", "tree").mapInArrow(fold, "host string, wrapper string, pages long, bodies long")
    return partial.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(finish, "host string, wrapper string, pages long, bodies long")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a row of ``pages``: page_id, url, text and n_chars.

    Blocks are joined by an empty line, white space inside a block is one
    space, character references are decoded. Null or empty HTML gives an
    empty text; pages without a host (null or odd urls) share a wrapper;
    repeated rows stay; an empty table gives an empty result. Text inside an
    article always stays, but for asides by tag or class word. On a page
    without an article, what ``template`` says of its host's wrapper goes; a
    host with one page only has no template. No text is
    capped: elements nested over 150 deep and rows of over 64 siblings only
    make the wrapper coarser (their order in it is not kept), and hosts with
    any number of different pages are folded in parts.
    """
    host = F.coalesce(F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")), F.lit("-"))
    pages = chosen(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host)
    wrappers = stored(infer_wrappers(pages))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for part in slices(batch, "html"):
                out = []
                for page, host, wrapper, bodies in zip(*(part.column(c).to_pylist() for c in ("html", "host", "wrapper", "bodies")), strict=True):
                    if host not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[host] = template(json.loads(wrapper)) if bodies > 1 else (set(), set())
                    out.append(page_text(blocks(page or "")[1], *known[host]))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    # Hosts with more pages than a quarter of a task's share, of which there are four a shuffle partition at most, are dealt to several tasks.
    share = (wrappers.agg(F.sum("pages")).first()[0] or 0) / (4 * shuffle_partitions(pages.sparkSession))
    frequent = wrappers.where(F.col("pages") > share).select("host", F.ceil(F.col("pages") / max(1, share)).cast("int").alias("salts"))
    # The stored table is compressed and not yet salted, so its size must not choose a broadcast.
    salted = wrappers.join(F.broadcast(frequent), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts", "pages")
    pages = pages.join(F.broadcast(frequent), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))).cast("int"))
    joined = pages.withColumn("page_id", F.col("page_id").cast("long")).join(salted.hint("merge"), ["host", "salt"]).select("page_id", "url", "html", "host", "wrapper", "bodies")
    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long")
