"""Main text of web pages by templates deduced from equivalence classes of tokens.

A page is a sequence of tokens: start and end tags of block elements and the texts between them, each told apart by the path of
the block elements around it. The occurrence vector of a token counts it in every page of its host. Tokens with equal vectors
form a class; classes that enough pages share and that hold enough tags, or a text, are candidates. A class is valid if its tokens keep
one order in all pages and its occurrences nest with those of the other classes, like brackets. The valid classes are the template:
texts in them are the host's fixed text, elements in them its skeleton, and what lies between is a slot.

1. Count: each task adds, for every (host, token), the pages, the occurrences and two sums of count * random number of the page
   modulo a prime. Equal vectors have equal sums; others meet by chance once in 2^62. Sums are combined before the
   shuffle, so a host with a third of all pages is as small as any other.
2. Classes: tokens in at least half of a host's pages, grouped by their sums. There are at most twice as many as a page has on
   average, so a template is of the size of a page.
3. Validate: every page checks order and nesting, and tells how many words each element of the skeleton holds.
4. Extract: text under menus, headers, footers, sidebars, notices, adverts, forms and comments goes, told by element, role,
   or the names of class and id; so does a block of fixed text. Of the rest, `article` is the main text, else
   `main`, else the slots in the element of the skeleton that holds most words in the host's pages, with the h1 beside it.

Pages are read three times and never shuffled; templates reach them by a broadcast if their measured size is below
`broadcast_bytes`, by a join on the host beyond. Fixed text goes only where a host has `least_text_pages` different contents, half as many as pages at
least, and only if it is the lesser part of the page: on hosts with few pages, or with copies of one page, a whole article is a constant. Where no template
is found, the page's own containers stand in for the skeleton.

Defined results: a null url has the host ""; null or empty html gives an empty text; unclosed elements end with their parents,
stray end tags are ignored, an unclosed tag, comment or script takes the rest; rows that repeat are answered each; an empty
table gives an empty result; other columns are ignored. Time and memory are linear in the length of a page.
"""
from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
BLOCK = frozenset("address article aside audio blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html iframe legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul video".split())
#: Their content is no markup; it ends at the end tag only.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
#: An element of these closes an open p; what else a start tag closes, and where the search for it stops.
ENDS_P = BLOCK - frozenset("body head html button object option optgroup svg video audio canvas tbody td tfoot th thead tr caption".split())
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",))}
ASIDE = frozenset("head nav aside footer form button select dialog menu search template svg object video audio canvas option".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog status menu menubar toolbar".split())
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
ASIDE_NAMES = COMMENTS | frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb
breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social
related recommended widget widgets login search pagination pager toolbar skip copyright""".split())
#: Containers that stand in for the skeleton where no template is found.
CONTAINERS = frozenset("body div section td center blockquote".split())
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CONTENT = -1  # place of the digests of whole contents
P1, P2 = (1 << 31) - 1, (1 << 31) - 19  # primes


class Element:
    """A block element: path, whether it or one around it is no main text, rank of the main element around it (article 2, main 1).

    Elements are shared between pages: `below` holds those that were opened inside, by start tag.
    """

    __slots__ = ("name", "path", "parent", "aside", "rank", "start", "end", "below")

    def __init__(self, name, path, parent, aside, rank):
        self.name, self.path, self.parent, self.aside, self.rank = name, path, parent, aside, rank
        self.start, self.end, self.below = path << 1 & (1 << 63) - 1, (path << 1 | 1) & (1 << 63) - 1, {}


def mark(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed) >> 1


def _described(name: str, attributes: str) -> tuple[str, frozenset, str, bool]:
    """(name with class and id, parts of these names, role, hidden) of a start tag."""
    if not attributes.strip():
        return name, frozenset(), "", False
    has = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    names = f"{has.get('class', '')} {has.get('id', '')}"
    parts = frozenset(x.lower() for x in NAME_PART.findall(names))
    hidden = "hidden" in has or "display:none" in has.get("style", "").replace(" ", "")
    role = "article" if has.get("itemprop") == "articleBody" else has.get("role", "").lower()
    return f"{name}.{re.sub(r'[0-9]+', '#', ' '.join(names.split()))}", parts, role, hidden


def _open(name: str, attributes: str, parent: Element) -> Element:
    label, parts, role, hidden = _described(name, attributes)
    rank = max(parent.rank, 2 if name == "article" or role == "article" else 1 if name == "main" or role == "main" else 0)
    if name in ("html", "body"):
        aside = False
    elif name in ("article", "main"):
        aside = hidden or bool(parts & {"comment", "reply"})  # not "comments-open"
    else:
        heads = (name == "header" or "header" in parts) and not rank and not parts & {"article", "entry", "post", "story", "content"}
        aside = hidden or heads or name in ASIDE or role in ASIDE_ROLES or bool(parts & ASIDE_NAMES)
    return Element(name, mark(label, parent.path), parent, aside or parent.aside, rank)


class Tree:
    """The elements that pages of a task share; begun anew when there are too many."""

    def __init__(self, most: int = 50_000):
        self.most, self.held, self.root = most, 0, Element("", 1, None, False, 0)

    def open(self, name: str, attributes: str, parent: Element) -> Element:
        e = parent.below.get((name, attributes))
        if e is None:
            self.held += 1
            e = parent.below[name, attributes] = _open(name, attributes, parent)
        return e

    def page(self) -> Element:
        if self.held > self.most:
            self.held, self.root = 0, Element("", 1, None, False, 0)
        return self.root


TREE = Tree()
RAW_END = {n: re.compile(f"</{n}(?=[\\s/>]|\\Z)", re.I) for n in RAW}


def scan(page: str) -> list[tuple[Element, int, str | None, int]]:
    """The page as (element, token, None, 0) for tags and (element, token, text, words in links) for blocks of text, in order."""
    top = TREE.page()
    out, stack, pieces, linked, in_link, at = [], [top], [], 0, False, 0
    opened: dict[str, int] = {}
    search, unescape = TAG.search, entities.unescape

    def flush() -> None:
        nonlocal linked
        if pieces:
            joined = " ".join("".join(pieces).split())
            if joined:
                out.append((stack[-1], mark(joined, stack[-1].path), joined, linked))
            pieces.clear()
        linked = 0

    def close(names: tuple, stop: tuple = ()) -> None:
        """Closes open elements down to the innermost of these names, unless one of `stop` stands before it."""
        for i in range(len(stack) - 1, 0, -1):
            name = stack[i].name
            if name in names:
                for e in reversed(stack[i:]):
                    opened[e.name] -= 1
                    out.append((e, e.end, None, 0))
                del stack[i:]
                return
            if name in stop:
                return

    while True:
        m = search(page, at)
        raw = page[at:m.start() if m else len(page)]
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if in_link:
                linked += len(raw.split())
        if m is None:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if m[1]:
                continue
            flush()
            end = RAW_END[name].search(page, at)
            if end is None:
                break
            at = page.find(">", end.end()) + 1 or len(page)
        elif name in BLOCK:
            flush()
            if m[1]:
                if opened.get(name):
                    close((name,))
                continue
            if name in ENDS_P and opened.get("p"):
                close(("p",), ("button", "td", "th", "table", "object"))
            if name in CLOSES:
                names, stop = CLOSES[name]
                if any(opened.get(n) for n in names):
                    close(names, stop)
            e = TREE.open(name, m[3], stack[-1])
            stack.append(e)
            opened[name] = opened.get(name, 0) + 1
            out.append((e, e.start, None, 0))
        elif name == "br":
            pieces.append(" ")
        elif name == "a":
            in_link = not m[1]
        elif name == "hr":
            flush()
    flush()
    return out


def _count(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*k, v[0], v[1], v[2] % P1, v[3] % P2) for k, v in held.items()]
            held.clear()
            kinds = (pa.string(), *[pa.int64()] * 6)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["host", "place", "token", "pages", "total", "s1", "s2"])

        for batch in batches:
            for host, page in zip(batch.column(1).to_pylist(), batch.column(2)):
                page = page.as_py() or ""
                r = mark(page, 7)
                a, b = r % P1, r // P1 % P2
                items = scan(page)
                counts = Counter((0 if x[2] is None else x[0].path, x[1]) for x in items)
                counts[0, 0] = 1  # the page itself
                counts[CONTENT, mark("\n".join(x[2] for x in items if x[2] is not None and not x[0].aside))] = 1
                for (place, token), n in counts.items():
                    v = held.get((host, place, token))
                    if v is None:
                        held[host, place, token] = [1, n, n * a, n * b]
                    else:
                        v[0] += 1
                        v[1] += n
                        v[2] += n * a
                        v[3] += n * b
                if len(held) > most:
                    yield flush()
        if held:
            yield flush()

    return run


class Template:
    """Classes of a host: tokens with their class, which of the classes are fixed text."""

    def __init__(self, flat: list[int] | None):
        self.token: dict[int, int] = {}
        self.fixed: set[int] = set()
        self.size: list[int] = []
        self.id: list[int] = []
        self.rank: list[tuple] = []
        i = 0
        while flat and i < len(flat):
            n, kind, ident = flat[i:i + 3]
            for t in flat[i + 3:i + 3 + n]:
                self.token[t] = len(self.size)
            if kind == 2:
                self.fixed.add(len(self.size))
            self.size.append(n)
            self.id.append(ident)
            self.rank.append((kind > 0, -n, ident))
            i += 3 + n


def check_nesting(sequence: list[int], template: Template) -> dict[int, tuple[int, int]]:
    """class -> (its order in this page, faults of order or nesting).

    Each class must be one order of its tokens again and again. Then classes are taken, tags before words and large before
    small; one whose occurrences cross those of a class taken before has a fault.
    """
    at: dict[int, list[int]] = {}
    for i, t in enumerate(sequence):
        at.setdefault(template.token[t], []).append(i)
    out, taken = {}, []
    for c in sorted(at, key=lambda c: template.rank[c]):
        own, n = at[c], template.size[c]
        first = [sequence[i] for i in own[:n]]
        order = mark(",".join(map(str, first)))
        faults = int(len(own) % n > 0 or len(set(first)) < n or any(sequence[i] != first[j % n] for j, i in enumerate(own)))
        if not faults:
            faults = int(any(_crosses(own, n, other, m) and _crosses(other, m, own, n) for other, m in taken))
            if not faults:
                taken.append((own, n))
        out[c] = (order, faults)
    return out


def _crosses(own: list[int], n: int, other: list[int], m: int) -> bool:
    """Some occurrence of the first class (n tokens each) doesn't lie in one gap between tokens of the other."""
    return any(bisect(other, own[i]) != bisect(other, own[i + n - 1]) for i in range(0, len(own), n))


def region_of(e: Element, template: Template) -> Element:
    """The innermost element of the skeleton around a block; without a template the innermost container."""
    while e.parent is not None and not (e.start in template.token if template.token else e.name in CONTAINERS):
        e = e.parent
    return e


def _held(known: dict, host: str, flat) -> Template:
    if host not in known:
        if len(known) > 500:
            known.clear()
        known[host] = Template(flat.as_py())
    return known[host]


def _validate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, kind 0, class, pages, order, order, faults) for classes; (host, kind 1, path of a region, words, 0, 0, 0)."""
    known: dict[str, Template] = {}
    for batch in batches:
        orders: dict[tuple, list[int]] = {}
        sizes: Counter = Counter()
        for host, page, flat in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            template, items = _held(known, host, flat), scan(page.as_py() or "")
            for c, (order, faults) in check_nesting([x[1] for x in items if x[1] in template.token], template).items():
                v = orders.setdefault((host, template.id[c]), [0, order, order, 0])
                v[0], v[1], v[2], v[3] = v[0] + 1, min(v[1], order), max(v[2], order), v[3] + faults
            for e, _, text, linked in items:
                if text is not None and not e.aside:
                    sizes[host, region_of(e, template).path] += len(text.split()) - 2 * linked
        rows = [(h, 0, c, *v) for (h, c), v in orders.items()] + [(h, 1, p, n, 0, 0, 0) for (h, p), n in sizes.items()]
        if rows:
            kinds = (pa.string(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["host", "kind", "id", "n", "low", "high", "faults"])


def main_text(page: str, template: Template, region: int | None) -> str:
    """The blocks of the main text, one a line."""
    blocks = [x for x in scan(page) if x[2] is not None and not x[0].aside]
    best = max((x[0].rank for x in blocks), default=0)
    if best:
        blocks = [x for x in blocks if x[0].rank == best]
    elif blocks:
        own = Counter()
        for e, _, text, linked in blocks:
            own[region_of(e, template).path] += len(text.split()) - 2 * linked
        if region not in own:
            region = max(own, key=lambda p: (own[p], -p))

        def inside(e: Element) -> Element | None:
            while e is not None and e.path != region:
                e = e.parent
            return e

        beside = {x.parent.path for b in blocks if (x := inside(b[0])) is not None and x.parent is not None and x.parent.name not in ("", "html")}
        blocks = [b for b in blocks if inside(b[0]) is not None or b[0].name == "h1" and b[0].parent.path in beside]
    if template.fixed:
        free = [b for b in blocks if template.token.get(b[1]) not in template.fixed]
        # where most is the host's, its pages are copies of each other and nothing is a frame
        if 2 * sum(len(b[2]) for b in free) >= sum(len(b[2]) for b in blocks):
            blocks = free
    return "\n".join(b[2] for b in blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Template] = {}
    for batch in batches:
        texts = [main_text(page.as_py() or "", _held(known, host, flat), region) for host, page, flat, region in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), batch.column(5).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _with_templates(pages: DataFrame, templates: DataFrame, broadcast_bytes: int) -> DataFrame:
    size = templates.agg(F.sum(F.coalesce(F.size("flat"), F.lit(0)) * 8 + F.octet_length("host") + 64).alias("n")).first().n or 0
    return pages.join(F.broadcast(templates) if size <= broadcast_bytes else templates, "host", "left")


def extract_main_text(table: DataFrame, least_pages: int = 3, least_text_pages: int = 8, least_size: int = 3, broadcast_bytes: int = 16_000_000, most_held: int = 200_000) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.lower(F.regexp_extract(after, r"^([^/?#]*)", 1))
    pages = table.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", F.coalesce(host, F.lit("")))
    slim = pages.select("page_id", "host", "html")
    counted = slim.mapInArrow(_count(most_held), "host string, place long, token long, pages long, total long, s1 long, s2 long")
    counted = counted.groupBy("host", "place", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "total", "s1", "s2")])
    # a token in one page only is in no template; the hosts' own rows give the number of pages and of different contents
    counted = cut(counted.where((F.col("pages") > 1) | (F.col("token") == 0) | (F.col("place") == CONTENT)).withColumn("s1", F.col("s1") % P1).withColumn("s2", F.col("s2") % P2))
    hosts = counted.where((F.col("token") == 0) | (F.col("place") == CONTENT)).groupBy("host").agg(F.max(F.when(F.col("token") == 0, F.col("pages"))).alias("of"), F.sum((F.col("place") == CONTENT).cast("long")).alias("contents"))
    frequent = counted.where((F.col("token") != 0) & (F.col("place") != CONTENT)).join(hosts, "host").where((F.col("of") >= least_pages) & (F.col("pages") * 2 >= F.col("of")))
    # texts are classes of their own path; fixed text stands once in nearly every page
    fixed = (F.col("place") != 0) & (F.col("contents") >= least_text_pages) & (F.col("contents") * 2 >= F.col("of")) & (F.col("pages") * 10 >= F.col("of") * 9) & (F.col("pages") == F.col("total"))
    classes = frequent.groupBy("host", "place", "pages", "total", "s1", "s2").agg(F.sort_array(F.collect_list("token")).alias("tokens"), F.max(F.when(fixed, 2).when(F.col("place") != 0, 1).otherwise(0)).alias("kind")).where((F.size("tokens") >= least_size) | (F.col("kind") > 0))
    ident = F.xxhash64("place", "pages", "total", "s1", "s2")
    flat = F.concat(F.array(F.size("tokens").cast("long"), F.col("kind").cast("long"), ident), "tokens")
    classes = cut(classes.select("host", ident.alias("id"), flat.alias("flat")))

    def collected(rows: DataFrame) -> DataFrame:
        return rows.groupBy("host").agg(F.flatten(F.sort_array(F.collect_list("flat"))).alias("flat"))

    first = cut(collected(classes))
    checked = _with_templates(slim, first, broadcast_bytes).select("page_id", "host", "html", "flat").mapInArrow(_validate, "host string, kind int, id long, n long, low long, high long, faults long")
    checked = cut(checked.groupBy("host", "kind", "id").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("faults").alias("faults")))
    valid = checked.where("kind = 0 and low = high and faults = 0").select("host", "id")
    template = collected(classes.join(valid, ["host", "id"], "left_semi"))
    most = checked.where("kind = 1").groupBy("host").agg(F.max(F.struct("n", "id")).alias("m")).select("host", F.col("m.id").alias("region"))
    template = cut(most.join(template, "host", "left"))
    full = _with_templates(pages, template, broadcast_bytes)
    return full.select("page_id", "url", "host", "html", "flat", "region").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
