"""Main text of web pages, with wrappers inferred per host as union-free regular expressions.

A page is read as a balanced stream of tags and texts. Recurring runs of one page's stream are folded into
repeated groups; then the streams of one host are aligned, one after the other and level by level: tokens that only some have become
optional groups, runs that now recur become repeated groups, and texts become slots. Streams of the
same form are merged once, in an order that does not depend on how pages are dealt to tasks.

The wrapper is the extractor. Every slot knows its host's pages, text, link text and whether its text ever
changes. The element whose changing, unlinked slots hold most of the host's text is the article; tags
like article and nav, and class words, only weigh in. A page gives the texts that fall in the
article's slots when it is aligned with the wrapper of its host.
"""

from __future__ import annotations

import copy
import html as htmllib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import lean, materialize, pick, release, table
from corpusmill.llm.urls import host_and_path

#: A text is of the template if so many different pages of its host, and this share of them, have it in the same place.
TEMPLATE_PAGES, TEMPLATE_SHARE = 5, 0.5
#: Groups in which the different streams of a host are merged first, by a hash of the stream.
SALTS = 64
#: Longest run of siblings that is looked for as a repeated group; siblings from which an element's wrapper goes by tags alone; nesting from which elements are taken as part of the one above.
PERIOD, WIDE, DEEP = 32, 48, 64
#: How much a hint by tag or class counts, up or down.
HINT = 8
#: Wrappers of hosts with at least this share of the pages are broadcast, so there are at most as many as its inverse; other hosts' are joined.
HOT_SHARE = 1 / 1000

_ATTRIBUTES = r"(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(noscript|template|svg|iframe|textarea|select|object)(?=[\s/>]){_ATTRIBUTES}(?<!/)>.*?</\2\s*>"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?<![^\s/\"'])(class|id|role|itemprop|hidden|aria-hidden)(?![^\s/=>])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
# Fixed values of HTML: names of elements by what they do.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr svg iframe noscript template textarea select object".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = _HEADINGS | frozenset("p blockquote pre".split())
#: Elements that are part of the text around them rather than a region of their own.
_PARTS = _PROSE | frozenset("address caption dd details dl dt figcaption figure legend li ol summary table tbody td tfoot th thead tr ul".split())
_NEVER = frozenset("nav head title menu button dialog".split())
#: What an opening tag closes, up to the next block.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
# Hints: roles, and class words or ids as a whole, that often stand for something other than the article.
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice newsletter popup modal sidebar navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments commentlist replies share sharing social related recommended pagination".split())

MARKED, WEAK, STRONG = 1, 2, 3


def _hint(tag: str, attributes: str, marked: bool) -> int:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        found.setdefault(name.lower(), value.strip("\"'").lower())
    role, words = found.get("role", ""), {*found.get("class", "").split(), found.get("id", "")}
    if tag in _NEVER or "hidden" in found or found.get("aria-hidden") == "true" or role in ("navigation", "menu", "menubar"):
        return STRONG
    # a header inside an article is the article's own
    if tag in ("footer", "aside", "form") or (tag == "header" and not marked) or role in _ROLES:
        return WEAK
    if words & _WORDS and tag not in ("html", "body", "main"):
        return WEAK
    return MARKED if tag in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articlebody" else 0


def _node(key: str, hint: int = 0) -> dict:
    return {"k": key, "h": hint, "lo": 1, "hi": 1, "c": []}


def _tag(node: dict) -> str:
    return node["k"].partition(".")[0]


class Block:
    __slots__ = ("text", "path", "links", "pieces", "inline", "node", "marked")

    def __init__(self, path: str, node: dict, marked: bool) -> None:
        self.pieces: list[str] = []
        self.links, self.text, self.path, self.node, self.marked = 0, "", path, node, marked
        self.inline: object = None


class _Frame:
    """An open element; open is the text block that goes on in it."""

    __slots__ = ("tag", "node", "path", "open", "block", "link", "marked")

    def __init__(self, tag: str, node: dict, path: str, block: bool, link: bool, marked: bool) -> None:
        self.tag, self.node, self.path, self.block, self.link, self.marked = tag, node, path, block, link, marked
        self.open: Block | None = None


def parse(page: str | None) -> tuple[list[Block], dict]:
    """Text blocks in page order, and the page's own wrapper: its folded stream, of which each slot lists its blocks.

    Inline elements belong to the text, except one that hints at something else, which is taken out of its paragraph,
    and one that holds a whole text between blocks. Elements without text are left out.
    """
    root = _node("#page")
    stack = [_Frame("#page", root, "", True, False, False)]
    blocks: list[Block] = []

    def add(text: str) -> None:
        if not text:
            return
        at = next(f for f in reversed(stack) if f.block)
        if at.open is None:
            if not text.strip():
                return
            slot = _node("#")
            at.node["c"].append(slot)
            at.open = Block(at.path, slot, at.marked)
            at.open.inline = stack[-1] if stack[-1] is not at and _tag(at.node) not in _PARTS else None
            blocks.append(at.open)
        elif at.open.inline is not None and at.open.inline not in stack and text.strip():
            at.open.inline = None
        at.open.pieces.append(text)
        if stack[-1].link:
            at.open.links += len(text.strip())

    page, at = page or "", 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[4] or m[7] or "").lower()
        if not tag:
            continue
        if m[3] or m[6]:  # a closing tag
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in _BLOCKS:
                        for f in stack[:i]:
                            f.open = None
                    del stack[i:]
                    break
                if tag not in _BLOCKS and stack[i].tag in _BLOCKS:
                    break
            continue
        attributes = m[5] or m[8] or ""
        block = tag in _BLOCKS
        if tag in _VOID:
            if block:
                for f in stack:
                    f.open = None
            elif tag in ("br", "img"):
                add(" ")
            continue
        if block:
            for f in stack:
                f.open = None
            closes = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    del stack[i:]
                    break
                if stack[i].tag in _BLOCKS and stack[i].tag not in ("p", "head"):
                    break
        if attributes.endswith("/") and not block:
            continue
        above = stack[-1]
        hint = _hint(tag, attributes, above.marked)
        classes = next((v.strip("\"'").lower() for n, v in _ATTRIBUTE.findall(attributes) if n.lower() == "class"), "") if attributes else ""
        own = (block or hint in (WEAK, STRONG)) and len(stack) < DEEP
        node, path = above.node, above.path
        if own:
            node = _node(tag + "".join(f".{c}" for c in classes.split()), hint)
            path = f"{path}/{node['k']}"
            next(f for f in reversed(stack) if f.block).node["c"].append(node)
        stack.append(_Frame(tag, node, path, own, above.link or tag == "a", above.marked or hint == MARKED))
    add(page[at:])
    kept: list[Block] = []
    for b in blocks:
        b.text = " ".join(htmllib.unescape("".join(b.pieces)).split())
        slot = b.node
        if not b.text:
            slot["k"] = ""
            continue
        h = _hash(b.text)
        slot["s"], slot["b"] = [1, len(b.text), min(b.links, len(b.text)), h, h], [len(kept)]
        kept.append(b)
        if b.inline is not None:  # an inline element that holds all of it
            inner = dict(slot)
            slot.clear()
            slot.update(_node(b.inline.tag) | {"c": [inner]})
            b.node = inner
    return kept, _folded(root)


def _folded(node: dict) -> dict:
    children = [_folded(c) if c["k"] != "#" else c for c in node["c"]]
    node["c"] = fold([c for c in children if c["k"] == "#" or c["c"]])
    return node


def _alike(a: dict, b: dict) -> bool:
    """Whether two siblings can be turns of one repeated group: one's tokens are those of the other but for less than half.

    A text of links is no turn of one that is not.
    """
    if a["k"] != b["k"] or _linked(a) != _linked(b):
        return False
    x, y = sorted(([c["k"] for c in a["c"]], [c["k"] for c in b["c"]]), key=len)
    if x == y:
        return True
    rest = iter(y)
    return 2 * len(x) > len(y) and all(k in rest for k in x)


def _linked(node: dict) -> bool:
    slots = [c for c in node["c"] if c["k"] == "#"] if node["k"] != "#" else [node]
    return sum(2 * c["s"][2] - c["s"][1] for c in slots) > 0


def _repeats(turns: list[dict], period: int) -> bool:
    """Two sections in a row are not yet a group: they are if a third follows, or other pages have another number of them."""
    return len(turns) > period and (period > 1 or len(turns) > 2 or _tag(turns[0]) in _PARTS or any(t["hi"] > 1 or t["lo"] < 1 for t in turns))


def fold(items: list[dict]) -> list[dict]:
    """Siblings with runs that follow each other put together: repeated elements, then repeated groups of several."""
    period = 1
    while period <= min(PERIOD, len(items) // 2):
        out, i, found = [], 0, False
        while i < len(items):
            j = i + period
            while j + period <= len(items) and all(_alike(items[i + k], items[j + k]) for k in range(period)):
                j += period
            if not _repeats(items[i:j], period):
                out.append(items[i])
                i += 1
                continue
            found = True
            for k in range(i + period, j):
                _merge(items[i + (k - i) % period], items[k])
            head = items[i]
            if period > 1:
                head = _node("") | {"c": items[i : i + period]}
            head["hi"] = 2
            out.append(head)
            i = j
        items = out
        period = 1 if found and period > 1 else period + 1
    return items


def _merge(a: dict, b: dict) -> dict:
    """a aligned with b, which has the same key; a is changed."""
    a["lo"], a["hi"], a["h"] = min(a["lo"], b["lo"]), max(a["hi"], b["hi"]), max(a["h"], b["h"])
    if a["k"] == "#":
        x, y = a.get("s"), b.get("s")
        if x and y:
            a["s"] = [x[0] + y[0], x[1] + y[1], x[2] + y[2], min(x[3], y[3]), max(x[4], y[4])]
        if "b" in a:
            a["b"] += b.get("b", ())
        return a
    if [c["k"] for c in a["c"]] == [c["k"] for c in b["c"]]:
        for x, y in zip(a["c"], b["c"]):
            _merge(x, y)
        return a
    out = []
    for x, y in aligned(a["c"], b["c"]):
        if x is not None and y is not None:
            out.append(_merge(x, y))
        else:
            only = x if x is not None else y
            only["lo"] = 0
            out.append(only)
    a["c"] = fold(out)
    if len(a["c"]) > WIDE:
        a["c"] = _by_tag(a["c"])
    return a


def _by_tag(items: list[dict]) -> list[dict]:
    """An element whose pages differ without end: its siblings by tag alone, each repeated and optional."""
    out: dict[str, dict] = {}
    for x in items:
        key = _tag(x) if len(out) < WIDE else "div"
        x["k"] = key
        if key in out:
            _merge(out[key], x)
        else:
            out[key] = x
        out[key]["lo"], out[key]["hi"] = 0, 2
    return list(out.values())


def _bag(node: dict) -> set[str]:
    return {node["k"]}.union(*(_bag(c) for c in node["c"])) if node["c"] else {node["k"]}


def aligned(a: list[dict], b: list[dict]) -> list[tuple[dict | None, dict | None]]:
    """Two streams of siblings side by side, in order; pairs have one key, and together hold as much in common as possible."""
    at, end = 0, 0
    while at < min(len(a), len(b)) and a[at]["k"] == b[at]["k"] and _alike(a[at], b[at]):
        at += 1
    while end < min(len(a), len(b)) - at and a[-1 - end]["k"] == b[-1 - end]["k"] and _alike(a[-1 - end], b[-1 - end]):
        end += 1
    x, y = a[at : len(a) - end], b[at : len(b) - end]
    middle: list[tuple[dict | None, dict | None]] = []
    if x and y:
        bx, by = [_bag(n) for n in x], [_bag(n) for n in y]
        best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = max(best[i + 1][j], best[i][j + 1])
                if x[i]["k"] == y[j]["k"]:
                    best[i][j] = max(best[i][j], best[i + 1][j + 1] + len(bx[i] & by[j]) / len(bx[i] | by[j]))
        i = j = 0
        while i < len(x) and j < len(y):
            if best[i][j] == best[i + 1][j]:
                middle.append((x[i], None))
                i += 1
            elif best[i][j] == best[i][j + 1]:
                middle.append((None, y[j]))
                j += 1
            else:
                middle.append((x[i], y[j]))
                i, j = i + 1, j + 1
        middle += [(n, None) for n in x[i:]] + [(None, n) for n in y[j:]]
    else:
        middle = [(n, None) for n in x] + [(None, n) for n in y]
    tail = len(a) - end
    return [*zip(a[:at], b[:at]), *middle, *zip(a[tail:], b[len(b) - end :])]


def merge(a: dict, b: dict) -> dict:
    """The wrapper of two wrappers."""
    return _merge(copy.deepcopy(a), copy.deepcopy(b))


def expression(node: dict) -> str:
    """The wrapper as a union-free regular expression over tags, with # for text slots."""
    inner = "#" if node["k"] == "#" else "".join(expression(c) for c in node["c"])
    sign = {(1, 1): "", (0, 1): "?", (1, 2): "+", (0, 2): "*"}[node["lo"], node["hi"]]
    if node["k"] == "#page":
        return inner
    text = inner if node["k"] in ("#", "") else f"<{node['k']}>{inner}</{_tag(node)}>"
    return f"({text}){sign}" if sign else text


def _slots(node: dict) -> Iterator[dict]:
    if node["k"] == "#":
        yield node
    for c in node["c"]:
        yield from _slots(c)


def _weight(slot: dict) -> int:
    """Characters outside links; a slot whose text never changes on many pages is of the template."""
    n, chars, links, least, most = slot["s"]
    return 0 if n >= TEMPLATE_PAGES and least == most else max(0, chars - links)


def choose(tree: dict) -> str | None:
    """Mark the slots ("keep") and elements ("in") of the article in a wrapper with counts; the article's path, None if there is none.

    Text counts for the nearest element around it that is no paragraph, list or table and not repeated. Parts next to
    the article with a fifth of its text belong to it, and so do headings before it if it has none.
    """
    own: dict[int, float] = {}
    where: list[tuple[dict, list[dict], float]] = []

    def visit(node: dict, above: list[dict], factor: float, marked: bool) -> None:
        node["keep"] = node["in"] = False
        if node["k"] == "#":
            holder = next((e for e in reversed(above) if e["k"] != "" and e["hi"] == 1 and _tag(e) not in _PARTS and _tag(e) in _BLOCKS), above[0])
            own[id(holder)] = own.get(id(holder), 0) + _weight(node)
            return
        factor *= {0: 1, MARKED: 1 if marked else HINT, WEAK: 1 / HINT, STRONG: 0}[node["h"]]
        where.append((node, above, factor))
        for c in node["c"]:
            visit(c, [*above, node], factor, marked or node["h"] == MARKED)

    visit(tree, [], 1.0, False)
    score, at = max((own.get(id(n), 0) * f, -i) for i, (n, _, f) in enumerate(where))
    if score <= 0:
        return None
    best, above, factor = where[-at]
    inside = any(e["h"] == MARKED for e in [*above, best])
    chosen = [best]
    if above and not inside:
        chosen += [n for n, up, f in where if up and up[-1] is above[-1] and n is not best and n["h"] == 0 and _tag(n) not in _PARTS and own.get(id(n), 0) * f >= score / 5]

    def take(node: dict, tag: str) -> None:
        node["in"] = True
        if node["k"] == "#":
            n, chars, links, _, _ = node["s"]
            node["keep"] = inside or tag in _PROSE or 2 * links <= chars
        for c in node["c"]:
            if c["h"] in (0, MARKED):
                take(c, _tag(node) if node["k"] else tag)

    for n in chosen:
        take(n, "")
    if not any(_tag(e) in _HEADINGS for e, _, _ in where if e["in"]):
        for e, up, f in where:
            if e is best:
                break
            if _tag(e) in ("h1", "h2") and f > 0 and not any(x["h"] in (WEAK, STRONG) for x in [*up, e]):
                for slot in _slots(e):
                    slot["keep"] = _weight(slot) > 0 or slot["s"][0] < TEMPLATE_PAGES
    return "/".join(e["k"] for e in [*above, best])


def fitted(page: dict, wrapper: dict) -> dict[int, bool]:
    """Whether each block of a parsed page stands in the article, by aligning its stream with the chosen wrapper."""
    out: dict[int, bool] = {}

    def rest(node: dict, inside: bool) -> None:
        for slot in _slots(node):
            out.update(dict.fromkeys(slot["b"], inside))

    def walk(a: dict, b: dict) -> None:
        if a["k"] == "#":
            out.update(dict.fromkeys(a["b"], b["keep"]))
            return
        x, y = a["c"], b["c"]
        pairs = zip(x, y) if [c["k"] for c in x] == [c["k"] for c in y] else aligned(x, y)
        for p, q in pairs:
            if p is None:
                continue
            if q is None:
                rest(p, b["in"] and p["h"] in (0, MARKED))
            else:
                walk(p, q)

    walk(page, wrapper)
    return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _skeleton(node: dict) -> list:
    return [node["k"], node["h"], node["lo"], node["hi"], [_skeleton(c) for c in node["c"]]]


def _tree(skeleton: list, stats: Iterator[list[int]] | None = None) -> dict:
    key, hint, lo, hi, children = skeleton
    node = {"k": key, "h": hint, "lo": lo, "hi": hi, "c": [_tree(c, stats) for c in children]}
    if key == "#" and stats is not None:
        node["s"] = next(stats)
    return node


_ROWS = "host string, slot bigint, page bigint, stream string, n_pages bigint, stats string"
_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())


def _batch(rows: list[tuple], types: tuple, ddl: str) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split(" ")[0] for c in ddl.split(", ")])


def observe(pages: DataFrame) -> DataFrame:
    """What is counted over all of pages(url, html), written once: the texts of every page by place, and each task's different streams of a host with the counts of their slots.

    Text rows (host, slot, page) name a page by a hash of its text; slot is null once for each page.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}

        def streams() -> list[tuple]:
            return [(h, None, None, s, v[0], json.dumps(v[1])) for (h, s), v in sorted(held.items())]

        for batch in batches:
            out: list[tuple] = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                blocks, tree = parse(page.as_py())
                own = _hash("\n".join(b.text for b in blocks))
                out += [(host, h, own, None, None, None) for h in {_hash(f"{b.path}\n{b.text}") for b in blocks}]
                out.append((host, None, own, None, None, None))
                key = host, json.dumps(_skeleton(tree), separators=(",", ":"))
                stats = [s["s"] for s in _slots(tree)]
                for s in stats:
                    s[0] = 1
                if key in held:
                    old = held[key]
                    held[key] = [old[0] + 1, [[x[0] + y[0], x[1] + y[1], x[2] + y[2], min(x[3], y[3]), max(x[4], y[4])] for x, y in zip(old[1], stats)]]
                else:
                    held[key] = [1, stats]
                if len(held) >= 5000:  # a task with very many streams passes them on as it goes
                    out += streams()
                    held = {}
            yield _batch(out, _TYPES, _ROWS)
        yield _batch(streams(), _TYPES, _ROWS)

    source = pick(pages, "url", "html").select(host_and_path(F.col("url"))[0].alias("host"), "html")
    return materialize(source.mapInArrow(lean(scan), _ROWS))


_PARTIAL = "host string, salt bigint, n_pages bigint, tree string"


def _align_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, salt, n_pages, stream, stats) sorted by all, to one wrapper for each (host, salt); one at a time is held."""
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    now: tuple | None = None
    tree: dict = {}
    total = 0

    def done() -> tuple:
        return (*now, total, json.dumps([_skeleton(tree), [s["s"] for s in _slots(tree)]]))

    for batch in batches:
        out = []
        for host, salt, n, stream, stats in zip(*(c.to_pylist() for c in batch.columns)):
            new = _tree(json.loads(stream), iter(json.loads(stats)))
            if (host, salt) == now:
                tree, total = _merge(tree, new), total + n
                continue
            if now is not None:
                out.append(done())
            now, tree, total = (host, salt), new, n
        if out:
            yield _batch(out, types, _PARTIAL)
    if now is not None:
        yield _batch([done()], types, _PARTIAL)


def wrappers_of(rows: DataFrame) -> DataFrame:
    """(host, n_pages, tree) of the rows of observe(): the wrapper of each host with the counts of its slots."""
    streams = rows.where("stream is not null").select("host", F.pmod(F.xxhash64("stream"), F.lit(SALTS)).alias("salt"), "n_pages", "stream", "stats")
    order = ["host", "salt", "stream", "n_pages", "stats"]
    first = streams.repartition("host", "salt").sortWithinPartitions(*order).mapInArrow(_align_rows, _PARTIAL)
    parts = first.select("host", F.lit(0).cast("bigint").alias("salt"), "n_pages", F.col("salt").alias("part"), "tree")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def split() -> Iterator[pa.RecordBatch]:
            for b in batches:
                pairs = [json.loads(t) for t in b.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([json.dumps(p[0]) for p in pairs], pa.string()), pa.array([json.dumps(p[1]) for p in pairs], pa.string())], names=["host", "salt", "n_pages", "stream", "stats"])

        yield from _align_rows(split())

    return parts.repartition("host").sortWithinPartitions("host", "part").mapInArrow(finish, _PARTIAL).select("host", "n_pages", "tree")


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, n_pages, wrapper, main) of every host in pages(url, html): the expression, and the article's path."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [_tree(s, iter(v)) for s, v in map(json.loads, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([expression(t) for t in trees], pa.string()), pa.array([choose(t) for t in trees], pa.string())], names=["host", "n_pages", "wrapper", "main"])

    return wrappers_of(observe(pages)).mapInArrow(render, "host string, n_pages bigint, wrapper string, main string")


def templates_of(rows: DataFrame) -> DataFrame:
    """(host, template, everywhere): hashes of the texts that stand in one place on most of the host's pages, and on all of them.

    Copies of one page count once, so that an article is not taken for template.
    """
    different = rows.where("stream is null").select("host", "slot", "page").distinct()
    counts = different.groupBy("host", "slot").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.where("slot is null").select("host", F.col("n").alias("total"))
    often = counts.where(F.col("slot").isNotNull() & (F.col("n") >= TEMPLATE_PAGES))
    # large hosts, of which there can only be so many, are broadcast and thus no hot key
    pages = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    large = F.broadcast(totals.where(F.col("total") >= F.lit(pages * HOT_SHARE)))
    small = totals.where(F.col("total") < F.lit(pages * HOT_SHARE))
    frequent = often.join(large, "host").unionByName(often.join(large.select("host"), "host", "left_anti").join(small, "host")).where(F.col("n") >= TEMPLATE_SHARE * F.col("total"))
    # at most a page's texts / TEMPLATE_SHARE for a host
    return frequent.groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("template"), F.sort_array(F.collect_list(F.when(F.col("n") == F.col("total"), F.col("slot")))).alias("everywhere"))


class Extractor:
    """The wrapper of a host, ready for its pages; pages of one form are aligned once."""

    def __init__(self, tree: str | None, template: list[int] | None, everywhere: list[int] | None) -> None:
        self.wrapper = None
        if tree is not None:
            skeleton, stats = json.loads(tree)
            self.wrapper = _tree(skeleton, iter(stats))
            if choose(self.wrapper) is None:
                self.wrapper = None
        self.template, self.everywhere = frozenset(template or ()), frozenset(everywhere or ())
        self.known: dict[str, list[bool]] = {}

    def kept(self, tree: dict) -> dict[int, bool]:
        if self.wrapper is None:
            return {}
        slots = list(_slots(tree))
        key = json.dumps(_skeleton(tree), separators=(",", ":"))
        have = self.known.get(key)
        if have is None:
            found = fitted(tree, self.wrapper)
            have = [found[s["b"][0]] for s in slots]
            if len(self.known) >= 200:
                self.known.clear()
            self.known[key] = have
        return {i: k for s, k in zip(slots, have) for i in s["b"]}

    def text(self, page: str | None) -> str:
        blocks, tree = parse(page)
        kept = self.kept(tree)
        if not any(kept.values()):  # a page of another kind than its host's articles: by its own wrapper
            choose(tree)
            kept = {i: s["keep"] for s in _slots(tree) for i in s["b"]}
        out = []
        for i, b in enumerate(blocks):
            drop = self.everywhere if b.marked else self.template
            if kept[i] and not (drop and _hash(f"{b.path}\n{b.text}") in drop):
                out.append(b.text)
        return "\n\n".join(out)


def main_text(page: str | None) -> str:
    """The text of a page that stands for its host alone."""
    return Extractor(None, None, None).text(page)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html).

    Null or empty html gives an empty text; so does a page without text outside menus and the like. Pages without
    a host form one group with an empty host. Cut-off pages are read up to their end. Repeated rows each get a row
    and count once in what a host repeats. A header in an article is the article's own; other headers go.
    No rows give no rows. Wrappers of at most 1 / HOT_SHARE hosts, those with most pages, are broadcast; the pages of the
    other hosts, none of which is large, are joined with theirs.
    """
    rows = observe(pages)
    stats = materialize(wrappers_of(rows).join(templates_of(rows), "host", "left"))
    release(rows)
    total = stats.agg(F.coalesce(F.sum("n_pages"), F.lit(0))).first()[0]
    is_hot = F.col("n_pages") >= F.lit(total * HOT_SHARE)
    hot = {r["host"]: (r["tree"], r["template"], r["everywhere"], r["n_pages"]) for r in stats.where(is_hot).collect()}
    shared = pages.sparkSession.sparkContext.broadcast({h: v[:3] for h, v in hot.items()})
    source = pick(pages, "page_id", "url", "html").withColumn("host", host_and_path(F.col("url"))[0])
    ddl = "page_id bigint, url string, text string, n_chars bigint"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Extractor] = {}
        for batch in batches:
            get = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            texts = []
            for i, (host, page) in enumerate(zip(get["host"].to_pylist(), get["html"])):
                if host not in ready:
                    if len(ready) >= 1000:
                        ready.clear()
                    ready[host] = Extractor(*((get[c][i].as_py() for c in ("tree", "template", "everywhere")) if "tree" in get else shared.value[host]))
                texts.append(ready[host].text(page.as_py()))
            yield pa.RecordBatch.from_arrays([get["page_id"], get["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if sum(v[3] for v in hot.values()) == total:
        return source.mapInArrow(lean(scan), ddl)
    known = F.col("host").isin(list(hot)) if hot else F.lit(False)
    cold = source.where(~known).join(stats.where(~is_hot).select("host", "tree", "template", "everywhere"), "host")
    return source.where(known).mapInArrow(scan, ddl).unionByName(cold.mapInArrow(scan, ddl))


def op7_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
