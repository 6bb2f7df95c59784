"""Main text of web pages, by wrappers inferred from pages of one host.

A page is a stream of tags and texts.  It is read as a union-free regular expression over block tags (with the words of
their classes) and text slots: neighbouring like elements, and neighbouring like runs of elements, are folded into
repeated groups.  The expressions of one host are aligned one after the other into its wrapper: a mismatch becomes an
optional item, a run beside a like one a repeated group, and texts that stand at one place fall into one text slot, which
sums up its characters, how many of them are links, and whether it has the same text on all pages.

Every text is taken through the wrapper.  A page's expression is matched with its host's (by the same alignment), so
that each of its texts falls into a slot.  From the slots follows the wrapper's main element: an article element or one
named so, if it holds enough of the host's changing text, else the deepest element with most of it.  A page gives the
texts of the slots in that element, but for those of menus, headers and footers of the page, sidebars, notices, adverts,
forms, scripts, styles and reader comments, and for slots with one text on TEMPLATE_PAGES or more different pages, which
are the host's template.  A page with no text in the main element is its own wrapper.

Only distinct expressions leave the pass over the pages, and they are merged in two rounds, sorted by expression, so that a large
host is never gathered in one task and ties between alignments are settled alike however pages are dealt.  Wrappers are sent to
all tasks while small (checked); else pages are dealt to salted copies of them.

Null html is the empty page, with empty text; null urls make one host; repeated rows are extracted each, and count
once where pages are counted; empty tables give empty results; extra columns are ignored; pages are read whole, however
long.  Elements nested more than MOST_DEPTH deep count as part of the one they stand in; their texts stay.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import cut

#: Wrappers are sent to all tasks up to this size.
BROADCAST_BYTES = 8 << 20
#: A text that is the same on so many different pages of a host is template.
TEMPLATE_PAGES = 8
#: Levels of elements that a wrapper tells apart, and elements in a repeated group.
MOST_DEPTH = 100
LONGEST_RUN = 6
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|svg|iframe|object|select|math|canvas)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S | re.I)
_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html", "head"}
_ENDS = {"li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
_SKIP_TAGS = frozenset("nav aside footer form head title button menu dialog label fieldset legend".split())
_SKIP_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar".split())
_SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation"
    " newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related reply replies respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription"
    " toolbar widget widgets".split()
)
_MAIN_WORDS = frozenset("article articlebody entry content maincontent main post story".split())
_SPLIT = re.compile(r"[^a-z]+")


def _label(tag: str, attrs: str) -> tuple[str, bool]:
    """(tag with the words of its class, id and role; whether the element is no part of an article)."""
    words: list[str] = []
    skip = tag in _SKIP_TAGS
    if attrs and not attrs.isspace():
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                skip = True
            elif name == "role":
                skip |= value.strip() in _SKIP_ROLES
                words += [w for w in _SPLIT.split(value) if w]
            elif name in ("class", "id", "itemprop"):
                words += [w for w in _SPLIT.split(value) if w]
        skip |= any(w in _SKIP_WORDS for w in words)
    return (f"{tag}.{'.'.join(dict.fromkeys(words))}" if words else tag), skip


# An item of an expression is [key, optional, repeated, body].  An element's key is its label ("!" before it: no part of an
# article) and its body a list of items; a group's key is "(" and the keys in it; a text slot's key is "#", and its body
# [characters, characters in links, hash of the text or None, hashes of up to TEMPLATE_PAGES pages, places of the texts].
_ALIKE = frozenset("p li dd dt tr td th option h1 h2 h3 h4 h5 h6 #".split())


def _merge_slots(a: list, b: list, same_page: bool) -> list:
    if same_page:
        text = zlib.crc32(b"%d %d" % (a[2], b[2]))
    else:
        text = a[2] if a[2] == b[2] else None
    return [a[0] + b[0], a[1] + b[1], text, sorted({*a[3], *b[3]})[:TEMPLATE_PAGES], a[4] + b[4]]


def _merge(a: list, b: list, same_page: bool = False) -> list:
    """One item for two of the same key."""
    body = _merge_slots(a[3], b[3], same_page) if a[0] == "#" else align(a[3], b[3], same_page)
    return [a[0], a[1] | b[1], a[2] | b[2] | same_page, body]


def _alike(a: list, b: list) -> float:
    """How well two items fit: 0 for different ones; containers are told apart by what they hold."""
    if a[0] != b[0]:
        return 0.0
    if a[0].lstrip("!").split(".")[0] in _ALIKE or a[0][0] == "(":
        return 2.0
    mine, other = {x[0] for x in a[3]}, {x[0] for x in b[3]}
    if not mine or not other:
        return 1.1
    return 1 + share if (share := len(mine & other) / len(mine | other)) or "." in a[0] else 0.0


def fold(items: list) -> list:
    """Neighbouring like items, then neighbouring like runs, as repeated items and groups (of one page)."""
    out: list = []
    for x in items:
        if out and out[-1][0] == x[0] and (x[0] == "#" or _alike(out[-1], x) >= 1.5):
            out[-1] = _merge(out[-1], x, True)
        else:
            out.append(x)
    for size in range(2, LONGEST_RUN + 1):
        if len(out) < 2 * size:
            break
        keys, done, i = [x[0] for x in out], [], 0
        while i < len(out):
            n = 1
            while keys[i : i + size] == keys[i + n * size : i + (n + 1) * size] and len(set(keys[i : i + size])) > 1:
                n += 1
            if n == 1:
                done.append(out[i])
                i += 1
                continue
            body = out[i : i + size]
            for k in range(1, n):
                body = [_within(x, y) for x, y in zip(body, out[i + k * size : i + (k + 1) * size])]
            done.append(["(" + " ".join(keys[i : i + size]) + ")", 0, 1, body])
            i += n * size
        out = done
    return out


def _grouped(items: list, groups: list[str]) -> list:
    """Runs of items that are one round of a group the other expression has, as that group."""
    for key in groups:
        names, out, i = key[1:-1].split(" "), [], 0
        while i < len(items):
            if [x[0] for x in items[i : i + len(names)]] == names:
                out.append([key, 0, 1, items[i : i + len(names)]])
                i += len(names)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(a: list, b: list, same_page: bool = False) -> list:
    """The union-free expression of both: items that fit are merged, in order, for the best sum; what only one has is
    optional; an item beside one that it fits becomes a repeat of it.  No item is lost."""
    if len(a) == len(b) and all(x[0] == y[0] for x, y in zip(a, b)) and (len(a) == 1 or all(_alike(x, y) for x, y in zip(a, b))):
        return [_merge(x, y, False) if not same_page else _within(x, y) for x, y in zip(a, b)]
    groups = [[x[0] for x in s if x[0][0] == "("] for s in (a, b)]
    a, b = _grouped(a, [k for k in groups[1] if k not in groups[0]]), _grouped(b, [k for k in groups[0] if k not in groups[1]])
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    fit = [[_alike(x, y) for y in b] for x in a]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            here = fit[i][j] + below[j + 1] if fit[i][j] else 0.0
            row[j] = max(here, below[j], row[j + 1])
    out: list = []
    i = j = 0

    def lone(x: list) -> None:
        if out and out[-1][0] == x[0] and x[0][0] != "(" and (x[0] == "#" or _alike(out[-1], x) >= 1.5):
            optional = out[-1][1]
            out[-1] = _within(out[-1], x) if same_page else _merge(out[-1], x)
            out[-1][1:3] = optional, 1
        else:
            out.append([x[0], 1, x[2], x[3]])

    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and fit[i][j] and best[i][j] == fit[i][j] + best[i + 1][j + 1]:
            out.append(_within(a[i], b[j]) if same_page else _merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            lone(a[i])
            i += 1
        else:
            lone(b[j])
            j += 1
    return out


def _within(a: list, b: list) -> list:
    """Items inside two rounds of a repeated item of one page: merged, but no repeats by themselves."""
    body = _merge_slots(a[3], b[3], True) if a[0] == "#" else align(a[3], b[3], True)
    return [a[0], a[1] | b[1], a[2] | b[2], body]


class Page:
    """The texts of a page's blocks, how much of each is links, and the page's expression."""

    def __init__(self, html: str):
        self.texts: list[str] = []
        self.links: list[int] = []
        stack: list[tuple[str, str]] = []  # tag, label
        bodies: list[list] = [[]]
        held: list[str] = []
        linked = 0
        links = 0

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                size = min(linked, len(text))
                bodies[-1].append(["#", 0, 0, [len(text), size, hash_text(text), [], [len(self.texts)]]])
                self.texts.append(text)
                self.links.append(size)
            linked = 0

        def pop() -> None:
            flush()
            _, label = stack.pop()
            if len(stack) < MOST_DEPTH:
                body = fold(bodies.pop())
                bodies[-1].append([label, 0, 0, body])

        for m in _TOKEN.finditer(html):
            raw, name, close, tag, attrs = m.group(0), m.group(1), m.group(2), m.group(3), m.group(4)
            if tag is None:
                if raw[0] != "<" or raw == "<":
                    text = unescape(raw)
                    held.append(text)
                    if links:
                        linked += len(text.strip())
                elif name and name.lower() == "textarea":
                    flush()
                continue
            tag = tag.lower()
            if tag not in _BLOCK:
                if tag == "br" or tag == "img":
                    held.append(" ")
                elif tag == "a":
                    links = max(0, links + (-1 if close else 1))
                continue
            if close:
                if any(t[0] == tag for t in stack):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                else:
                    flush()
                continue
            flush()
            if tag in _VOID:
                continue
            if tag in _CLOSES_P and stack and stack[-1][0] == "p":
                pop()
            while stack and stack[-1][0] in _ENDS.get(tag, ()):
                pop()
            label, skip = _label(tag, attrs)
            if tag == "header" and not any(t[0] in ("article", "main") for t in stack):
                skip = True
            if tag in ("body", "html"):
                skip = False
            if len(stack) < MOST_DEPTH:
                bodies.append([])
            stack.append((tag, "!" + label if skip else label))
        while stack:
            pop()
        flush()
        self.items = fold(bodies[0])
        whole = hash_text("\n".join(self.texts))
        for slot in slots(self.items):
            slot[3] = [whole]

    def shape(self) -> str:
        return _shape(self.items)


def _shape(items: list) -> str:
    """An expression without its slots' sums."""
    return " ".join(f"{k}{'?' * o}{'+' * r}" if k == "#" else f"{k}{'?' * o}{'+' * r}[{_shape(body)}]" for k, o, r, body in items)


def slots(items: list) -> list[list]:
    """The bodies of the text slots, in order."""
    out: list[list] = []
    for key, _, _, body in items:
        if key == "#":
            out.append(body)
        else:
            out += slots(body)
    return out


def _bare(items: list) -> list:
    """Without the places of one page's texts."""
    return [[k, o, r, [*body[:4], []] if k == "#" else _bare(body)] for k, o, r, body in items]


def content(items: list) -> list[list]:
    """The bodies of the slots whose texts are the article, by the sums of all slots."""
    gains: dict[tuple[int, ...], float] = {}
    labels: dict[tuple[int, ...], str] = {}
    found: list[tuple[tuple[int, ...], list]] = []

    def walk(part: list, at: tuple[int, ...]) -> float:
        total = 0.0
        for n, (key, _, _, body) in enumerate(part):
            here = (*at, n)
            if key == "#":
                chars = body[0] * 0.1 if body[2] is not None and len(body[3]) > 2 else body[0]
                total += max(0.0, chars - 2 * body[1])
                found.append((here, body))
            elif key[0] != "!":
                labels[here] = key if key[0] != "(" else ""
                gains[here] = gain = walk(body, here)
                total += gain
        return total

    whole = walk(items, ())
    tag = lambda p: labels[p].split(".")[0]
    named = [p for p in gains if tag(p) in ("article", "main") or _MAIN_WORDS & set(labels[p].split(".")[1:])]
    main: tuple[int, ...] = ()
    for pool in ([p for p in named if tag(p) == "article"], named):
        best = max(pool, key=lambda p: (gains[p], len(p), p), default=())
        if best and gains[best] >= 0.3 * whole:
            main = best
            break
    else:
        deep = [p for p, v in gains.items() if v >= 0.8 * whole and labels[p] and tag(p) not in ("p", "li", "h1", "h2", "h3", "td", "span")]
        main = max(deep, key=lambda p: (len(p), p), default=())
    inside = [body for at, body in found if at[: len(main)] == main]
    changing = [body for body in inside if body[2] is None or len(body[3]) < TEMPLATE_PAGES]
    return changing if any(body[2] is None for body in changing) else inside


def chosen(page: Page, wrapper: list) -> list[int]:
    """Places of the page's texts that are the article, in page order, by its match with its host's wrapper."""
    for items in (align(wrapper, page.items), align([], page.items)):
        places = sorted(i for body in content(items) for i in body[4])
        if places:
            return places
    return []


class Extractor:
    """Extraction with a host's wrapper; pages of one expression are matched once."""

    def __init__(self):
        self.known: dict[tuple[str, str], list[bool]] = {}

    def text(self, page: Page, host: str, wrapper: list) -> str:
        key = (host, page.shape())
        own = slots(page.items)
        keeps = self.known.get(key)
        if keeps is None:
            if len(self.known) > 20_000:
                self.known.clear()
            kept = set(chosen(page, wrapper))
            keeps = self.known[key] = [body[4][0] in kept for body in own]
        places = sorted(i for body, keep in zip(own, keeps) if keep for i in body[4])
        return "\n\n".join(page.texts[i] for i in places)


def hash_text(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


def _host(url) -> Column:
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://", ""), r"^([^/?#]*)", 1), r"^.*@", "")


def _expressions(pages: DataFrame) -> DataFrame:
    """(host, shape, wrapper) of the distinct expressions of each host and task."""

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}
        most = 5000

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": pa.array([k[0] for k in held], pa.string()), "shape": pa.array([k[1] for k in held], pa.string()), "wrapper": pa.array([json.dumps(_bare(w)) for w in held.values()], pa.string())})

        for batch in batches:
            for part in tx.chunks(batch, "html"):
                for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    page = Page(html or "")
                    key = (host, page.shape())
                    old = held.get(key)
                    if old is None:
                        held[key] = _bare(page.items)
                    else:
                        for mine, more in zip(slots(old), slots(page.items)):
                            mine[:4] = _merge_slots(mine, more, False)[:4]
                if len(held) > most:
                    yield out()
                    held.clear()
        yield out()

    return pages.mapInArrow(run, "host string, shape string, wrapper string")


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One wrapper for each value of the keys, aligning the rows in their order, a row in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, name = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": pa.array([name], pa.string()), "shape": pa.array([_shape(held)], pa.string()), "wrapper": pa.array([json.dumps(held)], pa.string())})

        for batch in batches:
            for row in batch.to_pylist():
                here, items = tuple(row[k] for k in keys), json.loads(row["wrapper"])
                if held is not None and here == key:
                    held = align(held, items)
                else:
                    if held is not None:
                        yield out()
                    key, held, name = here, items, row["host"]
        if held is not None:
            yield out()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "shape", "wrapper")
    return dealt.mapInArrow(run, "host string, shape string, wrapper string")


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, shape (the expression), wrapper (the expression with its slots' sums, JSON) of every host of pages(url, html)."""
    rows = _expressions(pages.select(_host(pages["url"].cast("string")).alias("host"), pages["html"].cast("string").alias("html")))
    rows = _merged(rows.withColumn("salt", F.pmod(F.xxhash64("shape"), F.lit(16))), ["host", "salt"])
    return cut(_merged(rows, ["host"]))


def extract_pages(pages: DataFrame, salts: int = 64) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    rows = rows.withColumn("host", _host(F.col("url")))
    wrappers = infer_wrappers(rows).select("host", "wrapper")
    size = wrappers.agg(F.sum(F.length("host") + F.length("wrapper") + 64)).first()[0] or 0
    known = {r["host"]: r["wrapper"] for r in wrappers.toLocalIterator()} if size <= BROADCAST_BYTES else None

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor, last, wrapper = Extractor(), None, []
        for batch in batches:
            for part in tx.chunks(batch, "html"):
                out: list[tuple] = []
                for page_id, url, html, host, given in zip(*(c.to_pylist() for c in part.columns)):
                    given = known.get(host) if known is not None else given
                    if given is not None and host != last:  # the host's wrapper stands before its pages
                        last, wrapper = host, json.loads(given)
                    if known is not None or given is None:
                        out.append((page_id, url, extractor.text(Page(html or ""), host, wrapper if host == last else [])))
                texts = [t for _, _, t in out]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = "page_id long, url string, text string, n_chars long"
    if known is not None:
        return rows.withColumn("wrapper", F.lit(None).cast("string")).mapInArrow(run, schema)
    salted = rows.withColumn("wrapper", F.lit(None).cast("string")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(salts)))
    copies = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    both = salted.unionByName(copies, allowMissingColumns=True).repartition("host", "salt")
    both = both.sortWithinPartitions("host", "salt", F.col("wrapper").desc_nulls_last())
    return both.select("page_id", "url", "html", "host", "wrapper").mapInArrow(run, schema)
